"""Facts of texts that are computed once for each distinct text instead of once for each row. Candidates of a pool repeat one
another, and answers of a data set do even more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.functions.answers import answer_facts, facts_match

#: Distinct texts, and their characters in all, up to which their facts are broadcast.
MOST_TEXTS, MOST_CHARS = 50_000, 16_000_000


def few(keyed: DataFrame, keys: list[str]) -> bool:
    """Are the distinct `keys` few enough for their facts to be broadcast? An estimate, so nothing is shuffled."""
    size = F.lit(0)
    for k in keys:
        size = size + F.coalesce(F.char_length(k), F.lit(0))
    n, longest = keyed.agg(F.approx_count_distinct(F.xxhash64(*keys)), F.max(size)).first()
    return n <= MOST_TEXTS and n * (longest or 0) <= MOST_CHARS


def with_facts(rows: DataFrame, keys: list[str], facts: dict[str, Column], texts: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """`rows` with `facts`, expressions over the columns `keys` alone. One pass counts the distinct keys; where they are few,
    facts are computed for those and broadcast, else in place, row by row. The result is the same either way. `texts`: rows
    with all keys that `rows` have, if there are some that are cheaper to make; a key that they lack is an error or, if they
    aren't `whole`, has its facts computed in place."""
    keyed = (rows if texts is None else texts).select(*keys)
    if rows.isStreaming or not few(keyed, keys):
        return rows.withColumns(facts)
    return _joined(rows, keyed.distinct(), keys, facts, whole)


def with_made(rows: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame], names: list[str], texts: DataFrame | None = None) -> DataFrame:
    """As with_facts() for the columns `names` that `make` adds to rows, a step that asks models or such and must give the same
    for the same `keys`: where distinct keys are few, those alone go through it."""
    once = None if rows.isStreaming else made_once(rows if texts is None else texts, keys, make, names)
    return make(rows).select(*rows.columns, *names) if once is None else joined_once(rows, once, keys, names)


def made_once(texts: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame | None:
    """What `make` adds to each distinct key, held by the driver as what is broadcast is, so that it is planned and run once;
    None where keys aren't few."""
    keyed = texts.select(*keys)
    return keyed.sparkSession.createDataFrame(make(keyed.distinct()).select(*keys, *names).toArrow()) if few(keyed, keys) else None


def joined_once(rows: DataFrame, once: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """`rows` with the columns `names` of made_once()."""
    return _joined(rows, once, keys, {n: F.col(n) for n in names})


def _joined(rows: DataFrame, once: DataFrame, keys: list[str], facts: dict[str, Column], whole: bool = True, empty: Column | None = None) -> DataFrame:
    own = once.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.struct(*[v.alias(n) for n, v in facts.items()]).alias("_own"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    found = rows.join(F.broadcast(own), same, "left")
    if whole:
        lost = F.raise_error(F.lit("a text is not among those whose facts are known")).cast(found.schema["_own"].dataType)
        found = found.withColumn("_own", F.coalesce("_own", lost if empty is None else F.when(~empty, lost)))
        return found.select(*rows.columns, *[F.col("_own")[n].alias(n) for n in facts])
    return found.withColumns({n: F.when(F.col("_own").isNull(), v).otherwise(F.col("_own")[n]) for n, v in facts.items()}).drop(*[f"_key_{k}" for k in keys], "_own")


def with_array_facts(pools: DataFrame, column: str, keys: list[str], facts: Callable[[Column], dict[str, Column]], texts: DataFrame | None = None, name: str = "_facts") -> DataFrame:
    """`pools` with `name`: the texts of the array `column` as structs of the text `c` and its `facts`, which are expressions over
    it and the columns `keys`. As with_facts(): where texts are few, they become rows, get their facts and are put together again
    by pool, which moves nothing if pools are partitioned by example_id. `texts`: rows (keys, c)."""
    keyed = pools.select(*keys, F.explode(column).alias("c")) if texts is None else texts.select(*keys, "c")
    made = lambda c: F.struct(c.alias("c"), *[v.alias(n) for n, v in facts(c).items()])
    if pools.isStreaming or not few(keyed, [*keys, "c"]):
        return pools.withColumn(name, F.transform(column, made))
    rest = [c for c in pools.columns if c != "example_id"]
    each = pools.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode_outer(column).alias("_at", "_c"))
    known = _joined(each, keyed.distinct().withColumnRenamed("c", "_c"), [*keys, "_c"], {"_made": made(F.col("_c"))}, empty=F.col("_at").isNull())
    item = F.when(F.col("_at").isNotNull(), F.struct("_at", "_made"))
    again = known.groupBy("example_id", "_row").agg(F.first(F.struct(*rest)).alias("_rest"), F.array_sort(F.collect_list(item)).alias("_items"))
    out = again.select("example_id", "_rest.*", F.transform("_items", lambda x: x["_made"]).alias(name))
    return out.withColumn(name, F.when(F.col(column).isNotNull(), F.col(name)))


def with_match(rows: DataFrame, name: str = "ok", prediction: str = "candidate", texts: DataFrame | None = None) -> DataFrame:
    """`rows` with `name`: answers_match() of the column `prediction`, gold_answer and answer_mode. Predictions are read once for
    each distinct text, or come with what was read of them as `_read`. `texts`: rows with the column `prediction`, as for with_facts()."""
    read = rows if "_read" in rows.columns else with_facts(rows, [prediction], {"_read": answer_facts(F.col(prediction))}, texts)
    return read.withColumn(name, facts_match(F.col("_read"), F.col("gold_answer"), F.col("answer_mode"))).drop("_read")
