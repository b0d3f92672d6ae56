"""Negatives come from the whole pool of answers."""

from pyspark.sql import functions as F

from poolwright.operators.ordered import negatives


def test_any_answer_can_be_drawn(spark):
    rows = spark.range(600).select(F.col("id").cast("string").alias("example_id"), (F.col("id") % 200).cast("string").alias("gold_answer"), F.lit("x").alias("kept"))
    answers = spark.range(400).select((F.col("id") % 200).cast("string").alias("answer"))
    got = negatives(rows, answers, 3, 7).collect()
    assert len(got) == 600 and all(len(set(r.negatives)) == 3 and r.gold_answer not in r.negatives and r.kept == "x" for r in got)
    assert len({a for r in got for a in r.negatives}) > 150
    assert {r.example_id: r.negatives for r in got} == {r.example_id: r.negatives for r in negatives(rows.repartition(7), answers.repartition(5), 3, 7).collect()}
    few = negatives(rows.limit(3), answers.where("answer in ('0', '1')"), 3, 7).collect()
    assert all(sorted(r.negatives) == sorted({"0", "1"} - {r.gold_answer}) for r in few)
    assert [r.negatives for r in negatives(rows.limit(1), answers.where("false"), 3, 7).collect()] == [[]]
