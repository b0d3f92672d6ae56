"""Positions of rows, where the plan that counts them is not the one that places them."""

from pyspark.sql import functions as F

from poolwright.operators import records as R


def test_positions_are_gapless_over_many_ranges(spark):
    """Other columns, which the counts don't need, make two shuffles of one: their bounds must not differ."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(0, 200_000, 1, 7).select((F.col("id") * 7919 % 200_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
        out = R.latest_position(rows, "k")
        again = out.select("k", F.col("pos").alias("p")).join(out, "k")  # used twice, as responses are joined to their problems
        n, places, low, high, same = again.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.count_if((F.col("p") == F.col("pos")) & (F.length("more") == 64))).first()
        assert (n, places, low, high, same) == (200_000, 200_000, 0, 199_999, 200_000)
        assert [r.pos for r in out.orderBy("k").limit(5).collect()] == [0, 1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_positions_of_no_rows(spark):
    assert R.latest_position(spark.range(0).withColumnRenamed("id", "k"), "k").collect() == []
