"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each larger (large star) or each smaller and the node itself (small star) to the least neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b; a > b) reaches; nodes without links are absent.

    Groups are never gathered: each round aggregates minima and joins them back. A round's edges are written to the
    shared folder; a hub's rows are joined to one minimum, which adaptive execution splits. Ends when a round changes
    nothing, after a number of rounds that grows with the logarithm of the longest path.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if seen == mark or not seen[0]:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.stored_at = edges.stored_at
            return out
        mark = seen
        grown = stored(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges = grown
