"""Joins by example_id, by position and by text; set operations on ids and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolwright.functions.answers import key, normalize_answer
from poolwright.functions.text import strip
from poolwright.operators.texts import with_facts


def last_by_id(rows: DataFrame, position: str, by: str = "example_id") -> DataFrame:
    """One row for each id: that of the largest position. Aggregates before the shuffle, so repeated ids cost nothing."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), position).alias("r")).select(by, "r.*")


def missing_ids(left: DataFrame, *others: DataFrame, by: str = "example_id") -> DataFrame:
    """(example_id, missing_in): ids of `left` that another table lacks."""
    out = [left.select(by).join(o.select(by), by, "left_anti").distinct().withColumn("missing_in", F.lit(i)) for i, o in enumerate(others)]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def inner_strict(left: DataFrame, *others: DataFrame, by: str = "example_id") -> DataFrame:
    """Joins on id; the query fails, naming an id, where one of `others` lacks it."""
    joined = left
    for i, o in enumerate(others):
        marked = o.withColumn(f"_in{i}", F.lit(True))
        joined = joined.join(marked, by, "left")
        fail = F.raise_error(F.concat(F.lit(f"input {i + 1} lacks "), F.col(by).cast("string")))
        joined = joined.withColumn(f"_in{i}", F.when(F.col(f"_in{i}").isNull(), fail.cast("boolean")).otherwise(True)).where(f"_in{i}").drop(f"_in{i}")
    return joined


def intersection(first: DataFrame, *others: DataFrame, by: str = "example_id") -> DataFrame:
    """Ids that all inputs have."""
    ids = first.select(by).distinct()
    for o in others:
        ids = ids.join(o.select(by), by, "left_semi")
    return ids


def left_default(left: DataFrame, right: DataFrame, defaults: dict[str, object], by: str = "example_id") -> DataFrame:
    return left.join(right, by, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def ordered_slice(ids: DataFrame, rows: DataFrame, strict: bool = True, by: str = "example_id", position: str = "pos") -> DataFrame:
    """Rows of `rows` for a list of ids (example_id, pos), in its order; an id that is listed twice gives its row twice."""
    found = ids.join(rows.withColumn("_found", F.lit(True)), by, "left" if strict else "inner")
    if strict:
        fail = F.raise_error(F.concat(F.lit("no row for "), F.col(by).cast("string")))
        found = found.withColumn("_found", F.when(F.col("_found").isNull(), fail.cast("boolean")).otherwise(True)).where("_found")
    return found.drop("_found")


def anti_slice(ids: DataFrame, without: DataFrame, n: int, by: str = "example_id") -> DataFrame:
    """The first n ids in text order that are not in `without`."""
    return ids.select(by).distinct().join(without.select(by), by, "left_anti").orderBy(by).limit(n)


def slot_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates of two pools side by side by slot, padded with nulls: (example_id, slot, before, after)."""
    zipped = a.select("example_id", F.col("candidates").alias("x")).join(b.select("example_id", F.col("candidates").alias("y")), "example_id", "full")
    return zipped.select("example_id", F.posexplode(F.arrays_zip(F.coalesce("x", F.array().cast("array<string>")), F.coalesce("y", F.array().cast("array<string>")))).alias("slot", "z")).select("example_id", "slot", F.col("z.0").alias("before"), F.col("z.1").alias("after"))


def pool_diff(pairs: DataFrame) -> DataFrame:
    same = F.col("before").eqNullSafe(F.col("after"))
    return pairs.agg(
        F.count("*").alias("slots"), F.count_if(~same & F.col("before").isNotNull() & F.col("after").isNotNull()).alias("changed"), F.count_if(F.col("before").isNull()).alias("added"),
        F.count_if(F.col("after").isNull()).alias("removed"), F.count_distinct(F.when(~same, F.col("example_id"))).alias("examples_changed"),
    )


def positional(left: DataFrame, right: DataFrame, position: str = "pos", by: str = "example_id", same_length: bool = False) -> DataFrame:
    """Rows paired by position. It ends with the shorter input unless `same_length`; paired rows must have the same id."""
    r = right.withColumnRenamed(by, "_id")
    joined = left.join(r, position, "full" if same_length else "inner")
    fine = F.col(by).eqNullSafe(F.col("_id"))
    checked = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("position"), F.col(position).cast("string"), F.lit("pairs"), by, "_id")).cast("boolean"))
    return joined.withColumn("_ok", checked).where("_ok").drop("_ok", "_id")


def by_ordinal(left: DataFrame, right: DataFrame, position: str = "pos", index: str = "global_index") -> DataFrame:
    return left.join(right, left[position] == right[index])


def text_scores(slots: DataFrame, scores: DataFrame, mode: Column | None = None, texts: DataFrame | None = None, score_texts: DataFrame | None = None) -> DataFrame:
    """`slots` with the margin that `scores` (example_id, candidate_answer, margin, pos) has for the candidate: by exact text
    (the last row of a text), else by normal form, else, with `mode`, by answer key (the first row of either). Scores of an
    example, a pool of which is capped, come together once and are looked up in its slots. `texts`, `score_texts`: rows (c) with
    all texts of either, if some are cheaper to make."""

    def read(rows: DataFrame, column: str, known: DataFrame | None, name: str) -> DataFrame:
        facts = {name: F.struct(strip(F.col(column)).alias("k0"), normalize_answer(F.col(column)).alias("k1"))}
        out = with_facts(rows, [column], facts, known.select(F.col("c").alias(column)) if known is not None else None)
        more = key(F.col(column), mode, "letter_then_number") if mode is not None else F.lit(None).cast("string")
        return out.withColumn(name, F.struct(f"{name}.k0", f"{name}.k1", more.alias("k2")))

    item = F.struct("pos", "margin", "_k.k0", "_k.k1", "_k.k2")
    per = read(scores.where("pos is not null"), "candidate_answer", score_texts, "_k").groupBy("example_id").agg(F.collect_list(item).alias("_scores"))
    out = read(slots, "candidate", texts, "_own").join(per, "example_id", "left")
    same = lambda k: F.transform(F.filter("_scores", lambda x: x[k] == F.col("_own")[k]), lambda x: F.struct(x["pos"].alias("pos"), x["margin"].alias("margin")))
    found = F.coalesce(F.array_max(same("k0"))["margin"], *[F.array_min(same(k))["margin"] for k in ("k1", "k2")[: 1 if mode is None else 2]])
    return out.withColumn("score", found).drop("_own", "_scores")


def score_fallback(slots: DataFrame, first: DataFrame, second: DataFrame, strict: bool = True) -> DataFrame:
    """Scores by (example_id, candidate) from `first`, else from `second`; with `strict` one of them must have it."""
    by = ["example_id", "candidate"]
    joined = slots.join(first.select(*by, F.col("score").alias("_a")), by, "left").join(second.select(*by, F.col("score").alias("_b")), by, "left")
    missing = F.raise_error(F.concat(F.lit("no score in "), F.col("example_id").cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    return joined.withColumn("score", F.coalesce("_a", "_b", missing)).drop("_a", "_b")


def selected_slot(slots: DataFrame, winners: DataFrame) -> DataFrame:
    """(example_id, selected_slot): where the logged winner text stands: equal text, else equal key, else equal normal form."""
    facts = lambda c: F.struct(strip(c).alias("text"), key(c, F.col("answer_mode"), "letter_then_number").alias("key"), normalize_answer(c).alias("same"))
    known = slots.select("answer_mode", "candidate")
    j = with_facts(slots, ["candidate", "answer_mode"], {"_t": facts(F.col("candidate"))}).join(winners.select("example_id", strip(F.col("prediction")).alias("w")), "example_id")
    j = with_facts(j, ["w", "answer_mode"], {"_w": facts(F.col("w"))}, known.select(strip(F.col("candidate")).alias("w"), "answer_mode"), whole=False)
    first = lambda n: F.min(F.when((F.col("_t")[n] == F.col("_w")[n]) & (F.col("w") != ""), F.col("slot")))
    return j.groupBy("example_id").agg(F.coalesce(*map(first, ("text", "key", "same"))).alias("selected_slot"))


def candidate_pairs(pools: DataFrame) -> DataFrame:
    """(example_id, i, j, left, right) for i < j: pairs within one capped pool, made inside its row."""
    n = F.size("candidates")
    left = pools.where(n > 1).select("example_id", "candidates", F.posexplode("candidates").alias("i", "left"))
    return left.where(F.col("i") < n - 1).select("example_id", "i", "left", "candidates", F.explode(F.sequence(F.col("i") + 1, n - 1)).alias("j")).select("example_id", "i", "j", "left", F.get("candidates", F.col("j")).alias("right"))


def union_shards(shards: list[DataFrame], expected: DataFrame, by: str = "example_id", position: str = "pos") -> DataFrame:
    """Shards in the order of the dataset `expected` (example_id, pos); fails on ids that are missing or come twice."""
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s)
    counted = whole.withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    j = expected.select(by, position).join(counted, by, "left")
    bad = F.raise_error(F.concat(F.lit("shards hold "), F.coalesce(F.col("_n").cast("string"), F.lit("0")), F.lit(" rows of "), F.col(by).cast("string"))).cast("boolean")
    return j.withColumn("_ok", F.when(F.col("_n") == 1, F.lit(True)).otherwise(bad)).where("_ok").drop("_ok", "_n").orderBy(position)


def attach_meta(rows: DataFrame, meta: DataFrame, columns: tuple[str, ...] = ("gold_answer", "problem"), by: str = "example_id") -> DataFrame:
    """`rows` whose columns are those of `meta` where it has them, else their own, else empty."""
    m = meta.select(by, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(m, by, "left").withColumns({c: F.coalesce(f"_{c}", c, F.lit("")) for c in columns}).drop(*[f"_{c}" for c in columns])


def by_slot(slots: DataFrame, side: DataFrame, index: str = "candidate_index") -> DataFrame:
    """Tags or scores by (example_id, slot)."""
    return slots.join(side.withColumnRenamed(index, "slot"), ["example_id", "slot"], "left")
