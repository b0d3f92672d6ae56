"""Selectors, merges and folds against plain Python on random small pools."""

import random

import pytest
from pyspark.sql import functions as F

from poolwright.functions import answers as A
from poolwright.operators import joins as J
from poolwright.operators import ordered as O
from poolwright.operators import pool as C
from poolwright.operators import select as S

TEXTS = ["4", "Final answer: 4", "The answer is 5.", "so the", "use at most 3", "7", "x = 7", "none here at all", "let me think 9", ""]


def make(spark, seed, n=40, most=6):
    r = random.Random(seed)
    rows = [(str(i), "How many?", "4", "numeric", c := [r.choice(TEXTS) for _ in range(r.randint(0, most))], [r.choice([None, 0.1, 0.2, 0.5, 1.0]) for _ in c]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "example_id string, problem string, gold_answer string, answer_mode string, candidates array<string>, margins array<double>")


def test_top_margin_and_parseable(spark):
    rows, df = make(spark, 1)
    low = float("-inf")
    parses = {t: any(c.isdigit() for c in t) for t in TEXTS}
    top = {r[0]: max(range(len(r[4])), key=lambda i: (low if r[5][i] is None else r[5][i], -i)) for r in rows if r[4]}
    got = {r.example_id: r.selected["index"] for r in S.select(df, "baseline_top_margin").collect()}
    assert got == top
    want = {r[0]: max([i for i in range(len(r[4])) if parses[r[4][i]]] or range(len(r[4])), key=lambda i: (low if r[5][i] is None else r[5][i], -i)) for r in rows if r[4]}
    assert {r.example_id: r.selected["index"] for r in S.select(df, "parseable_then_margin").collect()} == want


def test_first_if_close_needs_margins(spark):
    df = spark.createDataFrame([("1", "4", "numeric", ["4", "5"], [None, None]), ("2", "4", "numeric", ["4", "5"], [0.5, 0.6])], "example_id string, gold_answer string, answer_mode string, candidates array<string>, margins array<double>")
    assert {r.example_id: r.selected["index"] for r in S.select(df, "first_if_close_0.2").collect()} == {"1": 0, "2": 0}
    assert {r.example_id: r.selected["index"] for r in S.select(df, "first_if_close_0.05").collect()}["2"] == 1


def test_rule_names():
    assert S.parse_rule("clean_dup_firstclose_0.5_0.25_0.1") == S.Rule("clean_dup_firstclose", 0.5, 0.25, 0.1)
    with pytest.raises(ValueError):
        S.parse_rule("best")


def test_prefix_fill_and_dedupe(spark):
    df = spark.createDataFrame([(["4", "x", "4", "Final answer: 4", "5", "y"], "numeric")], "c array<string>, m string")
    r = df.select(O.prefix_fill(F.col("c"), 2, 4).alias("p"), O.dedupe_first(F.col("c"), F.col("m")).alias("d")).first()
    assert r.p == ["4", "x", "5", "Final answer: 4"] and r.d == ["4", "x", "5", "y"]


def test_anchor_merge(spark):
    schema = "example_id string, problem string, gold_answer string, answer_mode string, candidates array<string>"
    row = lambda c: spark.createDataFrame([("1", "", "4", "numeric", c)], schema)
    got = C.merge_anchor(row(["2", "3"]), row(["1", "2", "3"]), row(["3", "8", "9", "10", "8"]), most=4, protect=1, insertions=3).first()
    # 8 is appended; the slots of 3 and 2, which the base has, are overwritten from the end
    assert got.candidates == ["1", "10", "9", "8"] and (got.appended, got.replaced) == (1, 2)


@pytest.mark.parametrize("policy", ["replace_fragments_first", "replace_partials_first", "replace_margin_stratified_numeric_preserve", "replace_random_nonprefix", "append_if_room"])
def test_completion_merge(spark, policy):
    rows, df = make(spark, 2, n=30)
    got = C.merge_completion(df.withColumn("completions", F.array(F.lit("new 1"), F.lit("new 2"))), policy, most=5).collect()
    for r, (_, _, _, _, old, _) in zip(sorted(got, key=lambda r: int(r.example_id)), rows, strict=True):
        old = old[:5]
        assert len(r.candidates) <= 5 and r.candidates[:1] == (old[:1] or ["new 1"])
        if len(old) < 5:
            assert r.candidates == (old + ["new 1", "new 2"])[:5]
        elif policy != "append_if_room":
            assert [c for i, c in enumerate(old) if i not in r.removed] + ["new 1", "new 2"] == r.candidates


def test_matched_fresh(spark):
    schema = "example_id string, answer_mode string, candidates array<string>"
    base = spark.createDataFrame([("1", "numeric", ["1", "2", "3"])], schema)
    fresh = spark.createDataFrame([("1", "numeric", ["3", "", "5", "6", "7"])], schema)
    slots = spark.createDataFrame([("1", 1), ("1", 2), ("1", 9)], "example_id string, slot int")
    got = C.matched_fresh(base, fresh, slots, 3).first()
    assert got.candidates == ["1", "5", "6"] and (got.applied, got.missing) == (2, 0)


def test_joins(spark):
    a = spark.createDataFrame([("1", 0), ("2", 1)], "example_id string, pos int")
    b = spark.createDataFrame([("1", "x")], "example_id string, v string")
    assert J.missing_ids(a, b).collect()[0].example_id == "2"
    with pytest.raises(Exception, match="lacks 2"):
        J.inner_strict(a, b).collect()
    with pytest.raises(Exception, match="shards hold 0 rows of 2"):
        J.union_shards([b], a).collect()
    assert [r.v for r in J.ordered_slice(spark.createDataFrame([("1", 0), ("1", 1)], "example_id string, pos int"), b).collect()] == ["x", "x"]


def test_bucket_sample_and_positions(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("example_id"), (F.col("id") % 3 == 0).alias("b"), "id")
    got = {(r.b, r.id) for r in O.bucket_sample(rows, "b", 2, "id").collect()}
    assert got == {(True, 0), (True, 3), (False, 1), (False, 2)}


def test_merge_anchor_with_keys_at_hand(spark):
    """Pools that hold their keys, and base pools that are the anchor's first candidates, give the same without taking pools
    apart or joining the anchor with itself."""
    pools = [["1", "2", "3"], ["Final answer: 1", "1", " 2"], ["x"], [], ["7", None]]
    of = lambda ps: spark.createDataFrame([(str(i), "p", "numeric", p) for i, p in enumerate(ps)], "example_id string, problem string, answer_mode string, candidates array<string>")
    anchor, aux = of(pools), of([["3", "8", "9", "10", "8"], ["2.0", "so 5"], None, ["4"], ["6"]])
    keyed = lambda d: d.withColumn("k", F.transform("candidates", lambda c: A.key(c, F.col("answer_mode"))))
    want = C.merge_anchor(anchor.withColumn("candidates", F.slice("candidates", 1, 2)), anchor, aux, most=4)
    rows = lambda d: sorted(map(repr, d.select("example_id", "candidates", "appended", "replaced").collect()))
    got = C.merge_anchor(2, keyed(anchor), keyed(aux), most=4, keys="k")
    assert rows(got) == rows(want) == rows(C.merge_anchor(2, anchor, aux, most=4)) and got.columns == want.columns


def test_slots_are_normalised_as_pools_are(spark):
    """once for each distinct text, with the same texts and actions as in pools."""
    said = ["Final answer: 7", "The answer is 7.", "7", "so the total is the", "", "Final answer: 7"]
    slots = spark.createDataFrame([("numeric", t) for t in said], "answer_mode string, candidate string")
    pool = C.normalize_pool(spark.createDataFrame([("numeric", said)], "answer_mode string, candidates array<string>")).first()
    got = C.normalize_slots(slots)
    assert "_key_" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.candidate, r.action) for r in got.collect()) == sorted(zip(pool.candidates, pool.actions, strict=True))
