"""Expressions that name a costly part once: what is written out twice is computed twice."""

from pyspark.sql import functions as F

from poolwright.functions import answers as A
from poolwright.functions import hygiene as H
from poolwright.functions import motif as Q
from poolwright.functions import text as T
from poolwright.operators import ordered as O
from poolwright.plans.adapters import slots


def times(column, part: str) -> int:
    return column._jc.toString().count(part)


def test_costly_parts_are_named_once(spark):
    t, p, m = F.col("t"), F.col("p"), F.col("m")
    assert times(Q.motif(p, t), "concat(") <= 3 and times(Q.quality(t), "short_chars") == 1
    assert times(O.prefix_fill(F.col("xs"), 2, 5), "boxed") == times(A.extract_numeric(t), "boxed")
    assert times(H.format_candidate(t, m), "the answer is") == 1


def test_prefix_fill_of_a_long_pool(spark):
    xs = [f"Final answer: {i % 40}{'.0' * (i % 2)}" for i in range(200)]
    got = spark.createDataFrame([(xs,)], "xs array<string>").select(O.prefix_fill(F.col("xs"), 2, 50).alias("k")).first().k
    assert got[:40] == [f"Final answer: {i}{'.0' * (i % 2)}" for i in range(40)] and len(got) == 40


def test_clipped_texts_are_collapsed_once(spark):
    """A text is collapsed once, and not searched for runs of blanks where it can have none."""
    assert times(T.clip(F.col("t"), 40), "regexp_replace") == 1
    cases = {" a  b ": "a b", "a b": "a b", " a": "a", "a\tb": "a b", "a\u00a0b \u2003c": "a b c", "\u00e9 a": "\u00e9 a", "a \x1c b": "a b", "  ": "", "": "", "\n": "", None: None}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    got = [(r.y, r.z) for r in rows.select("i", T.collapse(F.col("x")).alias("y"), T.clip(F.col("x"), 4).alias("z")).orderBy("i").collect()]
    assert got == [(y, y if y is None or len(y) <= 4 else y[:1] + "...") for y in cases.values()]


def test_slots_and_golds_take_one_window(spark, sf):
    """Places and gold answers of an example come from one pass over its rows."""
    plan = slots(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == 1
