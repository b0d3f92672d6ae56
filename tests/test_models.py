"""Stand-ins for models: each distinct prompt is asked once, and pools are scored without joining themselves."""

from functools import partial

import __spark_entry__ as entry
from poolwright.operators import models as U
from poolwright.operators import texts as X
from poolwright.plans import pipelines
from poolwright.plans.adapters import problems, slots


def text_of(plan) -> str:
    return plan._jdf.queryExecution().optimizedPlan().toString()


def shuffles(plan) -> int:
    return plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(example_id")


def test_margins_are_the_same_once_and_in_place(spark, monkeypatch):
    """a text that examples share is scored once; both scorers go through the rows together, without a join."""
    rows = spark.createDataFrame([("e", 0, "p", "numeric", "7", "7"), ("e", 1, "p", "numeric", None, "7"), ("f", 0, "p", "numeric", "7", "8"), ("f", 1, "q", None, "", "8")], "example_id string, slot int, problem string, answer_mode string, candidate string, gold_answer string")
    scorers = {"margin": partial(U.HashScorer, 2), "base_margin": partial(U.HashScorer, 1)}
    want = {n: {(r.example_id, r.slot): r.margin for r in U.score_candidates(rows, s).collect()} for n, s in scorers.items()}
    for most in (50_000, 0):
        monkeypatch.setattr(X, "MOST_TEXTS", most)
        got = U.with_margins(rows, scorers)
        assert {n: {(r.example_id, r.slot): r[n] for r in got.collect()} for n in scorers} == want
        assert text_of(got).count("Join ") == (1 if most else 0)


def test_problems_are_the_slots_distinct_ones(spark, sf):
    names = ["example_id", "problem", "gold_answer", "answer_mode"]
    for kind in ("num", "choice"):
        assert sorted(problems(spark, sf, kind).select(names).collect()) == sorted(slots(spark, sf, kind).select(names).distinct().collect())


def test_generated_rerank_asks_each_prompt_once(spark, sf):
    """pools are made once and scored where they are; one shuffle for problems, one for flags at most."""
    plan = entry.queries()["stub_generate_rerank"](spark, sf)
    assert shuffles(plan) <= 1 and text_of(plan).count("MapInPandas") == 0


def test_fixed_pools_are_shuffled_once(spark, sf, monkeypatch):
    """slots are shuffled once, many texts as few ones, and never joined with themselves."""
    plan = entry.queries()["stub_rerank"](spark, sf)
    want = plan.first()
    assert shuffles(plan) == 1 and "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(X, "MOST_TEXTS", 0)
    assert pipelines.fixed_pool(slots(spark, sf), partial(U.HashScorer, 1), partial(U.HashScorer, 2)).first() == want


def test_generated_pools_are_the_same_once_and_in_place(spark, monkeypatch):
    """F8: a problem that examples share is asked once, and what is written for it is read once."""
    rows = spark.createDataFrame([("e", "p", "7", "numeric"), ("f", "p", "8", "numeric"), ("g", "q", "A", "choice_letter"), ("h", None, "7", "numeric")], "example_id string, problem string, gold_answer string, answer_mode string")
    asked = spark.sparkContext.accumulator(0)

    class Counting(U.HashGenerator):
        def generate(self, prompts, n):
            asked.add(len(prompts))
            return super().generate(prompts, n)

    once = sorted(U.generate_pools(rows, partial(Counting, 3), 8, 4).collect())
    assert asked.value == 3
    monkeypatch.setattr(X, "MOST_TEXTS", 0)
    assert once == sorted(U.generate_pools(rows, partial(Counting, 3), 8, 4).collect()) and asked.value == 7


def test_repairs_leave_slots_where_they_are(spark, sf):
    """one shuffle of slots, none joined with themselves."""
    plan = entry.queries()["stub_repair"](spark, sf)
    assert shuffles(plan) == 1 and "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
