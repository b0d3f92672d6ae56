"""Exact paired statistics as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.functions.text import let


def rate(n: Column, of: Column, default: float | None = 0.0) -> Column:
    """n / of; `default` where `of` is 0."""
    out = F.try_divide(n.cast("double"), of.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def mcnemar_exact(a_only: Column, b_only: Column) -> Column:
    """Two-sided exact binomial tail on the discordant pairs, 1 where there are none. Terms are added in log space, each
    from the one before it."""
    n, k = a_only + b_only, F.least(a_only, b_only)
    first = -n.cast("double") * F.log(F.lit(2.0))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))).alias("s"))
    many = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(many, F.struct(first.alias("t"), F.exp(first).alias("s")), step, lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def pair_columns(a: str, b: str) -> list[Column]:
    """How often two boolean columns hold together and alone; null doesn't hold."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    return [F.count("*").alias("n"), F.count_if(x & ~y).alias("a_only"), F.count_if(y & ~x).alias("b_only"), F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither")]


def paired_counts(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Counts of two boolean columns against each other, accuracies, delta and McNemar's p, by the columns `by`."""
    return paired_rates(rows.groupBy(*by).agg(*pair_columns(a, b)))


def paired_rates(counted: DataFrame) -> DataFrame:
    """Rows of pair_columns() with accuracies, delta and McNemar's p."""
    out = counted.withColumns({"accuracy_a": rate(F.col("a_only") + F.col("both"), F.col("n")), "accuracy_b": rate(F.col("b_only") + F.col("both"), F.col("n"))})
    return out.withColumns({"delta": F.col("accuracy_b") - F.col("accuracy_a"), "p_value": mcnemar_exact(F.col("a_only"), F.col("b_only"))})


def uniform(seed: int, *counters: Column) -> Column:
    """A number between 0 and 1, both excluded, for a seed and counters: the same wherever and however often it is drawn."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in counters])), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def binomial(n: Column, hits: Column, of: Column, u: Column) -> Column:
    """The number of successes of `n` draws that succeed with probability hits / of, by inverting the distribution at `u`.

    Weights run from 12 deviations and 30 below the mean to as much above it, each from the one before; what lies outside
    weighs less than a double can tell. Twice as many steps as weights, no matter how large n is in itself.
    """

    def place(s: Column) -> Column:
        steps = F.when(s["high"] > s["low"], F.sequence(s["low"], s["high"] - 1)).otherwise(F.array().cast("array<long>"))
        weight = lambda w, k: w * ((s["n"] - k).cast("double") / (k + 1).cast("double")) * s["odds"]
        whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), lambda a, k: let(weight(a["w"], k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))), lambda a: a["sum"])
        walk = lambda goal: F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), s["low"].alias("at")),
            lambda a, k: let(weight(a["w"], k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), (a["at"] + (a["sum"] < goal).cast("long")).alias("at"))),
            lambda a: a["at"],
        )
        return let(whole * s["u"], walk)

    p = hits.cast("double") / of.cast("double")
    far = 12 * F.sqrt(n.cast("double") * p * (1 - p)) + 30
    low, high = F.greatest(F.lit(0).cast("long"), F.floor(n * p - far)), F.least(n.cast("long"), F.ceil(n * p + far))
    facts = F.struct(n.cast("long").alias("n"), low.cast("long").alias("low"), high.cast("long").alias("high"), (hits.cast("double") / (of - hits).cast("double")).alias("odds"), u.alias("u"))
    return F.when((n <= 0) | (hits <= 0), F.lit(0).cast("long")).when(hits >= of, n.cast("long")).otherwise(let(facts, place))


def bootstrap_ci(rows: DataFrame, a: str, b: str, samples: int = 2000, seed: int = 7) -> DataFrame:
    """(delta, low, high) of the mean of b - a under resampling.

    A resample of n paired outcomes is decided by how often each of the three outcomes -1, 0 and 1 is drawn, so the pairs
    are counted once, and each replicate draws first how many differ, then how many of those are 1: exact resampling whose
    work doesn't grow with rows x samples, from numbers that seed, replicate and draw decide alone. Bounds are the sorted
    deltas at int(.025 B) - 1 and int(.975 B) - 1. No rows: all 0.
    """
    d = F.coalesce(F.col(b).cast("int"), F.lit(0)) - F.coalesce(F.col(a).cast("int"), F.lit(0))
    return resampled(rows.select(d.alias("d")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count("*").alias("n")), samples, seed)


def resampled(counts: DataFrame, samples: int = 2000, seed: int = 7) -> DataFrame:
    """bootstrap_ci() from its one row of counts (up, down, n)."""
    n, both = F.col("n"), F.col("up") + F.col("down")
    drawn = counts.sparkSession.range(samples).join(F.broadcast(counts)).withColumn("differ", binomial(n, both, n, uniform(seed, F.col("id"), F.lit(1))))
    drawn = drawn.withColumn("rise", binomial(F.col("differ"), F.col("up"), both, uniform(seed, F.col("id"), F.lit(2))))
    deltas = drawn.select(rate(2 * F.col("rise") - F.col("differ"), n).alias("x"))
    at = lambda q: F.element_at("xs", max(1, int(q * samples)))
    bounds = deltas.agg(F.array_sort(F.collect_list("x")).alias("xs")).select(at(0.025).alias("low"), at(0.975).alias("high"))
    return counts.select(rate(F.col("up") - F.col("down"), n).alias("delta")).join(F.broadcast(bounds))


def ovf_decomposition(o1: Column, v1: Column, o2: Column, v2: Column) -> Column:
    """struct(coverage, conversion): what more coverage and better selection each add to the final accuracy."""
    return F.struct(((o2 - o1) * v1).alias("coverage"), (o2 * (v2 - v1)).alias("conversion"))


def missing_budgets(observed: Column, wanted: tuple[int, ...] = (4, 8, 16, 32)) -> Column:
    return F.array_except(F.array(*map(F.lit, wanted)), observed)
