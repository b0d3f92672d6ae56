"""Sharding by fixed virtual slots.

Records hash into thousands of slots; bytes and rows are aggregated by slot, and a versioned map says which shard holds
each slot. Rebalancing edits the map: a shard keeps its heaviest slots up to its share, the rest of its slots move to the
least loaded shards, heaviest first. All of it is DataFrame work; the map has one row for each slot and version, a size
that no table changes, and so it may be broadcast and folded in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolwright.llm.common import stored

SLOTS, SHARDS = 8192, 8


def slot_of(*key: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0 (virtual_slot, shard, version): slots dealt round."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalance(held: DataFrame, load: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map `held` for `load` (virtual_slot, bytes): shard sizes near equal, few slots moved.

    `load` may lack slots (they weigh nothing and stay) and be empty. Slots of shards beyond `shards` move too, so the
    same edit takes a shard out or in.
    """
    weighed = held.join(F.broadcast(load.select("virtual_slot", F.col("bytes").cast("long"))), "virtual_slot", "left").fillna(0, ["bytes"])
    total = Window.partitionBy()
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    share = F.sum("bytes").over(total) / F.lit(shards)
    marked = weighed.withColumn("stays", (F.col("shard") < shards) & (F.sum("bytes").over(order) <= share))
    load_of = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("slots", lambda x: x.stays & (x.shard == s)), F.lit(0).cast("long"), lambda a, x: a + x.bytes))
    one = marked.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "shard", "stays", "bytes", "version"))).alias("slots"))
    one = one.select("slots", load_of.alias("loads"), F.filter("slots", lambda x: ~x.stays).alias("moving"))
    least = lambda loads: F.array_position(loads, F.array_min(loads)).cast("int") - 1
    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))
    moved = F.aggregate(
        "moving",
        start,
        lambda a, x: F.struct(F.transform(a.loads, lambda v, i: F.when(i == least(a.loads), v + x.bytes).otherwise(v)).alias("loads"), F.concat(a.to, F.array(least(a.loads))).alias("to")),
    )
    to = one.select("slots", F.transform(F.arrays_zip("moving", moved.to.alias("to")), lambda z: F.struct(z["moving"]["virtual_slot"].alias("virtual_slot"), z["to"].alias("to"))).alias("edits"))
    edits = to.select(F.explode("edits").alias("e")).select("e.virtual_slot", "e.to")
    return held.join(F.broadcast(edits), "virtual_slot", "left").select("virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"))


def latest(maps: DataFrame) -> DataFrame:
    """The newest version of a stored map."""
    newest = maps.agg(F.max("version").alias("version"))
    return maps.join(F.broadcast(newest), "version").select("virtual_slot", "shard", "version")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, held: DataFrame | None = None, maps_to: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) for each row of `docs`.

    Law `bytes`: sizes (UTF-8 bytes, null none, plus 1) of the shards are near equal. slot numbers a shard's rows without
    gaps, by virtual slot, doc_id and text hash. The virtual slot is a hash of doc_id and text, so null or repeated
    doc_ids spread; identical rows are counted before the shuffle and take neighbouring numbers. Other columns are not
    read; a table without rows gives none.

    `held` is a stored map of an earlier run (virtual_slot, shard, version), whose newest version is edited, so few slots
    move; without one, slots are dealt round first. All versions are written to `maps_to`, if it is given.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of("doc_id", text, slots=slots).alias("virtual_slot"))
    kinds = own.groupBy("virtual_slot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    kinds = stored(kinds, "kinds")
    load = stored(kinds.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")), "load")
    maps = first_map(docs.sparkSession, shards, slots) if held is None else held.select("virtual_slot", "shard", "version")
    maps = stored(maps.unionByName(rebalance(latest(maps), load, shards)), "maps")
    if maps_to:
        maps.write.mode("errorifexists").parquet(maps_to)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = latest(maps).join(F.broadcast(load), "virtual_slot").withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = kinds.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(placed.select("virtual_slot", "shard", "base", "version")), "virtual_slot")
    numbered = at.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("ahead") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
