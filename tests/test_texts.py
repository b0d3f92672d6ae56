"""Facts of distinct texts, broadcast or in place, and pools that give up slots."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from poolwright.functions.answers import answers_match

from poolwright.operators import joins as J
from poolwright.operators import pool as C
from poolwright.operators import texts as X


def test_facts_are_the_same_broadcast_and_in_place(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, None, "x"), (4, "", None), (5, None, None)], "i int, t string, p string")
    facts = {"n": F.char_length("t"), "both": F.concat_ws("-", "p", "t")}
    few = X.with_facts(rows, ["t", "p"], facts)
    monkeypatch.setattr(X, "MOST_TEXTS", 0)
    many = X.with_facts(rows, ["t", "p"], facts)
    assert sorted(map(tuple, few.select("i", "n", "both").collect())) == sorted(map(tuple, many.select("i", "n", "both").collect()))
    assert "join" in few._jdf.queryExecution().optimizedPlan().toString().lower() and "join" not in many._jdf.queryExecution().optimizedPlan().toString().lower()


def test_policies_ask_for_what_they_read(spark):
    assert "salvage" not in C._read("replace_fragments_first") and "salvage" in C._read("replace_margin_salvage_no_risk")
    rows = spark.createDataFrame([("e", "p", "numeric", ["1", "2", "so the"], [1.0, 2.0, 3.0], ["9"])], "example_id string, problem string, answer_mode string, candidates array<string>, margins array<double>, completions array<string>")
    for most, want in ((3, ["1", "2", "9"]), (4, ["1", "2", "so the", "9"])):
        assert C.merge_completion(rows, "replace_invalid_first", most=most).first().candidates == want


def test_facts_of_texts_that_others_name(spark, monkeypatch):
    """Texts that are cheaper to make must hold all keys, unless what they lack is computed in place."""
    rows, other = spark.createDataFrame([("a",), ("bb",), (None,)], "t string"), spark.createDataFrame([("a",), (None,)], "t string")
    facts = {"n": F.char_length("t")}
    assert sorted(X.with_facts(rows, ["t"], facts, other, whole=False).collect(), key=repr) == sorted(X.with_facts(rows, ["t"], facts).collect(), key=repr)
    with pytest.raises(Exception, match="not among"):
        X.with_facts(rows, ["t"], facts, other).collect()


def test_array_facts_keep_pools(spark, monkeypatch):
    pools = spark.createDataFrame([("e", "p", ["b", "a", "b"]), ("e", "q", ["a", None]), ("f", "p", []), ("g", "p", None)], "example_id string, p string, xs array<string>").repartition(3)
    of = lambda: sorted(map(repr, X.with_array_facts(pools, "xs", ["p"], lambda c: {"both": F.concat(c, "p")}).select("example_id", "p", "xs", "_facts").collect()))
    few = of()
    monkeypatch.setattr(X, "MOST_TEXTS", 0)
    assert few == of() and "Row(c='b', both='bp'), Row(c='a', both='ap'), Row(c='b', both='bp')" in few[0]


def test_match_is_that_of_answers(spark, monkeypatch):
    golds, said = ["7", "-7", "007", "7.0", "1e2", "C", "c", "(C)", "so it is", " 7", "", None, "Final answer: 7"], ["Final answer: 7.0", "answer: C", "c", "7 of 8", "-7", "so it is", "", None, "100"]
    rows = spark.createDataFrame([(g, t, m) for g in golds for t in said for m in ("numeric", "choice_letter", "text", None)], "gold_answer string, candidate string, answer_mode string")
    for most in (50_000, 0):
        monkeypatch.setattr(X, "MOST_TEXTS", most)
        assert X.with_match(rows).withColumn("want", answers_match(F.col("candidate"), F.col("gold_answer"), F.col("answer_mode"))).where("not ok <=> want").count() == 0


def test_texts_are_read_once(spark, sf):
    """Reports, selectors and merges over pools join facts of texts instead of reading each row's text."""
    for name in ("paired_counts", "family_keys", "candidate_pairs", "selector_first_if_close_2000", "merge_anchor", "family_hygiene", "running_metrics", "merge_policy_replace_fragments_first", "selected_slot"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "_key_" in plan, name


def test_scores_of_an_example_come_together_once(spark, sf, monkeypatch):
    slots = spark.createDataFrame([("e", " The 7. "), ("e", "the 7."), ("e", "8"), ("e", "Final answer: 8"), ("e", None), ("f", "x"), ("g", "")], "example_id string, candidate string")
    scores = spark.createDataFrame([("e", "The 7.", 1.0, 0), ("e", "the 7", 2.0, 1), ("e", "The 7.", None, 2), ("e", "the 7.", 4.0, 3), ("e", "answer: 8", 5.0, 4), ("e", None, 6.0, 5), ("e", "THE 7.", 8.0, None), ("g", "", 9.0, 1)], "example_id string, candidate_answer string, margin double, pos int")
    for mode, most in ((None, 50_000), (None, 0), (F.lit("numeric"), 50_000)):
        monkeypatch.setattr(X, "MOST_TEXTS", most)
        got = sorted(((r.example_id, r.candidate, r.score) for r in J.text_scores(slots, scores, mode).collect()), key=repr)
        last = 5.0 if mode is not None else None
        assert [g for g in got if g[:2] in (("e", "8"), ("e", "Final answer: 8"))] == [("e", "8", last), ("e", "Final answer: 8", last)]
        assert [g[2] for g in got if g[1] in (" The 7. ", "the 7.", None, "x", "")] == [1.0, 4.0, None, None, 9.0]
    monkeypatch.undo()
    plan = entry.queries()["text_scores"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(example_id") == 2  # one for the slots, one for the scores
