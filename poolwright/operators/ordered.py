"""Order-sensitive operators inside one example, samples and prefixes. Every order is total, so results don't depend on
how rows are dealt out; random orders are hashes of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolwright.functions.answers import extract_numeric, key
from poolwright.functions.text import let
from poolwright.operators.texts import with_match


def _per(*order: Column | str):
    return Window.partitionBy("example_id").orderBy(*order)


def duplicate_ranks(slots: DataFrame, k: Column) -> DataFrame:
    """`slots` with dup_key, dup_rank (0-based, by slot) and group_size."""
    by = Window.partitionBy("example_id", "dup_key")
    return slots.withColumn("dup_key", k).withColumns({"dup_rank": F.row_number().over(by.orderBy("slot")) - 1, "group_size": F.count("*").over(by)})


def first_correct_position(ok: Column) -> Column:
    """1-based position of the first true in an array, null if there is none."""
    return F.nullif(F.array_position(ok, True), F.lit(0))


def budget_curve(slots: DataFrame, most: int = 16) -> DataFrame:
    """For each k up to `most`: share of examples whose first k candidates hold a right one, share whose best-scored of the
    first k is right (earliest on ties), and the marginal gain of k. A pool shorter than k counts with all it has.

    Rows grow with examples x `most`, a parameter; prefix answers are running aggregates over one sort by example."""
    run = _per("slot").rowsBetween(Window.unboundedPreceding, 0)
    order = F.struct(F.coalesce(F.col("margin"), F.lit(float("-inf"))), -F.col("slot"))
    steps = with_match(slots).select("example_id", "slot", F.bool_or("ok").over(run).alias("any_ok"), F.max_by("ok", order).over(run).alias("best_ok"), F.lead("slot", 1, most).over(_per("slot")).alias("until"))
    # a row answers for every k from slot + 1 until the next slot exists
    ks = steps.where(F.col("slot") < most).select(F.explode(F.sequence(F.col("slot") + 1, F.least("until", F.lit(most)))).alias("k"), "any_ok", "best_ok")
    curve = ks.groupBy("k").agg(F.count("*").alias("examples"), F.avg(F.col("any_ok").cast("int")).alias("oracle_rate"), F.avg(F.col("best_ok").cast("int")).alias("best_rate"))
    return curve.withColumn("gain", F.col("oracle_rate") - F.lag("oracle_rate", 1, 0.0).over(Window.orderBy("k")))


def dedupe_first(candidates: Column, mode: Column, most: int | None = None, profile: str = "mode_aware") -> Column:
    """The array with only the first of each key, at most `most` of them."""
    keyed = F.transform(candidates, lambda c: F.struct(c.alias("c"), key(c, mode, profile).alias("k")))
    first = let(keyed, lambda a: F.transform(F.filter(a, lambda x, i: F.array_position(F.transform(a, lambda y: y["k"]), x["k"]) == i + 1), lambda x: x["c"]))
    return F.slice(first, 1, most) if most else first


def prefix_fill(candidates: Column, prefix: int, most: int) -> Column:
    """Text-unique candidates: the first `prefix`, then those with a number not seen among the ones kept, then the rest, up
    to `most`."""

    def of(s: Column) -> Column:
        a, numbers = s["a"], s["numbers"]
        head = F.slice(a, F.lit(1), F.least(F.lit(prefix), F.size(a)))

        def fresh(t: Column, i: Column) -> Column:
            n = F.get(numbers, i)
            return (i >= prefix) & n.isNotNull() & (F.array_position(numbers, n) == i + 1)

        new = F.filter(a, fresh)
        rest = F.filter(a, lambda t, i: (i >= prefix) & ~F.coalesce(fresh(t, i), F.lit(False)))
        return F.slice(F.concat(head, new, rest), 1, most)

    # numbers are read once for each text, not for each pair of texts
    return let(let(F.array_distinct(candidates), lambda a: F.struct(a.alias("a"), F.transform(a, extract_numeric).alias("numbers"))), of)


def context_topk(tags: DataFrame, k: int) -> DataFrame:
    """The k best attempts of each example to show a generator: by quality, match with the problem's motif, length up to 40
    words, slot; each text once."""
    rank = F.coalesce(*[F.when(F.col("quality_label") == q, F.lit(i)) for i, q in enumerate(("complete_attempt", "partial_solution", "fragment"))], F.lit(3))
    order = [rank, (F.col("motif_label") != F.col("problem_motif_label")).cast("int"), -F.least(F.size(F.split("candidate_text", " ")), F.lit(40)), F.col("candidate_index")]
    once = tags.withColumn("_n", F.row_number().over(Window.partitionBy("example_id", "candidate_text").orderBy(*order))).where("_n = 1")
    return once.withColumn("rank", F.row_number().over(_per(*order))).where(F.col("rank") <= k).drop("_n")


def repair_topk(slots: DataFrame, k: int, protect: int = 1) -> DataFrame:
    """The k slots of each example most in need of repair; the first `protect` are left alone. Columns: quality_label,
    invalid, leak, scaffold, margin."""
    rank = F.when(F.col("quality_label") == "fragment", 0).when(F.col("quality_label") == "partial_solution", 1).otherwise(2)
    order = [F.desc("invalid"), F.desc("leak"), F.desc("scaffold"), rank, F.coalesce("margin", F.lit(float("-inf"))), F.col("slot")]
    return slots.where(F.col("slot") >= protect).withColumn("rank", F.row_number().over(_per(*order))).where(F.col("rank") <= k)


def repair_targets(slots: DataFrame, k: int, protect: int = 1) -> DataFrame:
    """All slots with `target`: whether repair_topk() has them."""
    need = [F.desc("invalid"), F.desc("leak"), F.desc("scaffold"), F.when(F.col("quality_label") == "fragment", 0).when(F.col("quality_label") == "partial_solution", 1).otherwise(2), F.coalesce("margin", F.lit(float("-inf"))), F.col("slot")]
    return slots.withColumn("_rank", F.row_number().over(_per(F.col("slot") < protect, *need))).withColumn("target", (F.col("slot") >= protect) & (F.col("_rank") <= k)).drop("_rank")


def beam(rows: DataFrame, width: int, by: str = "example_id") -> DataFrame:
    """The `width` best distinct texts of each group: by score, then text."""
    once = rows.groupBy(by, "text").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "text"))).where(F.col("rank") <= width)


def pair_rank(pairs: DataFrame) -> DataFrame:
    """Ranks from pairwise scores (example_id, left, right, score > 0: left wins): by wins, then score, then text."""
    sides = pairs.select("example_id", F.explode(F.array(F.struct(F.col("left").alias("t"), F.col("score").alias("s")), F.struct(F.col("right").alias("t"), (-F.col("score")).alias("s")))).alias("x"))
    sums = sides.groupBy("example_id", F.col("x.t").alias("text")).agg(F.count_if(F.col("x.s") > 0).alias("wins"), F.sum("x.s").alias("score"))
    return sums.withColumn("rank", F.row_number().over(_per(F.desc("wins"), F.desc("score"), "text")))


def bucket_sample(rows: DataFrame, bucket: str, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each bucket in the given order, then by id. Every task keeps n rows of a bucket before the rows
    meet, so a bucket that holds most rows costs no task more."""
    fields = [F.struct(*[F.col(c) if isinstance(c, str) else c for c in (*order, "example_id")]).alias("o"), F.struct(*rows.columns).alias("r")]
    best = F.slice(F.array_sort(F.collect_list(F.struct(*fields))), 1, n)
    parts = rows.withColumn("_part", F.spark_partition_id())
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", bucket).orderBy(*[F.col(c) if isinstance(c, str) else c for c in (*order, "example_id")]))).where(F.col("_rank") <= n)
    return ranked.groupBy(bucket).agg(best.alias("_best")).select(F.explode("_best").alias("_one")).select("_one.r.*")


def sample_seeded(rows: DataFrame, n: int, seed: int, *ids: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n rows without replacement, of each stratum `by` if there are any: those of least hash of seed and ids, the same however
    the table is partitioned. Every task keeps n rows, or n of each stratum, before rows meet, so neither a sort of the table
    nor a stratum that holds most of it comes to one task."""
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])), *ids]
    if not by:
        return rows.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def shuffle_seeded(values: Column, seed: int, salt: Column) -> Column:
    """An array in hash order."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(F.xxhash64(F.lit(seed), salt, v, i).alias("h"), i.alias("i"), v.alias("v")))), lambda x: x["v"])


def negatives(rows: DataFrame, answers: DataFrame, count: int, seed: int) -> DataFrame:
    """`rows` with `negatives`: up to `count` distinct answers that differ from gold_answer, drawn by hash of seed, example and
    draw from all distinct `answers` (answer).

    Answers are numbered in hash order, each partition from where the one before ends, and drawn numbers are joined to them,
    so nothing is broadcast. A row draws consecutive numbers from a start of its own, one to spare in place of gold. Where
    there are fewer answers than asked for, all of them are given."""
    own = answers.select("answer").where("answer is not null").distinct().select(F.xxhash64(F.lit(seed), "answer").alias("_h"), "answer")
    # a number within each of 4096 buckets by hash, and bucket starts from their counts: no window holds all answers
    bucket = own.withColumn("_b", F.pmod("_h", F.lit(4096)))
    sizes = bucket.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_from", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_from", F.lit(0)).alias("_from"))
    numbered = bucket.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "answer")) - 1).join(F.broadcast(starts), "_b").select((F.col("_i") + F.col("_from")).alias("_number"), "answer")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    keyed = rows.join(F.broadcast(total))
    start = F.pmod(F.xxhash64(F.lit(seed), "example_id"), F.col("_total"))
    keys = keyed.select("example_id", "gold_answer", "_total").distinct().where("_total > 0")
    draws = keys.select("example_id", "gold_answer", F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.lit(count), F.col("_total") - 1).cast("int")), lambda i: F.pmod(start + i, F.col("_total")))).alias("_at", "_number"))
    drawn = draws.join(numbered, "_number").where("answer <> gold_answer").groupBy("example_id", "gold_answer")
    found = drawn.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_at", "answer"))), lambda x: x["answer"]), 1, count).alias("negatives"))
    found = found.withColumnsRenamed({"example_id": "_example", "gold_answer": "_gold"})
    out = rows.join(found, rows["example_id"].eqNullSafe(found["_example"]) & rows["gold_answer"].eqNullSafe(found["_gold"]), "left").drop("_example", "_gold")
    return out.withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>")))


def limit_prefix(rows: DataFrame, position: str, n: int, offset: int = 0) -> DataFrame:
    """Rows `offset` to `offset + n` in the order of a position column."""
    return rows.orderBy(position).offset(offset).limit(n)


def top_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def policy_order(rows: DataFrame, column: str, policies: list[str]) -> DataFrame:
    """Rows by place in a configured list, others after it by name."""
    at = F.array_position(F.array(*map(F.lit, policies)), F.col(column))
    return rows.orderBy(F.when(at > 0, at).otherwise(len(policies) + 1), column)


def shard(rows: DataFrame, position: str, shards: int, index: int) -> DataFrame:
    return rows.where(F.pmod(F.col(position), F.lit(shards)) == index)
