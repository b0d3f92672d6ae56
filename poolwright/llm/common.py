"""What the text operators share: reading tables, the shared work folder, Arrow batches in bounded slices."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of text that one numpy pass works on; a single longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 500
#: Keys with more than one in HOT_KEYS of all rows, of which there can be no more than HOT_KEYS, are dealt over SPREAD tasks.
HOT_KEYS, SPREAD = 4096, 64
#: Bits of a filter of keys. As bitmaps of 4 KB it takes 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder, by a path that Spark resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of
    its own; a cluster has no folder that could be guessed, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="poolwright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: cuts lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/poolwright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_rows(docs: DataFrame) -> DataFrame:
    """`docs` stored as (id, row): a number for each row, which reading again doesn't change, and its columns as a struct, so
    that none of their names meets another."""
    return stored(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")


def plain_rows(rows: DataFrame) -> DataFrame:
    """The columns that with_rows() put into the struct."""
    return rows.select("row.*")


def split_join(rows: DataFrame, keys: DataFrame, on: list[str], part: Column, how: str = "inner") -> DataFrame:
    """`rows` joined to stored `keys`, one row a key with n, the number of its rows: hot keys are repeated SPREAD times and
    their rows dealt by `part` (any whole number), so that no task gets all rows of a key. Fewer than HOT_KEYS keys are
    broadcast, whatever the input: each has more than one in HOT_KEYS of the counted rows."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS > F.lit(total)
    each = keys.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(hot, SPREAD - 1).otherwise(0)))).drop("n")
    marked = rows.withColumn("_part", part).join(F.broadcast(keys.where(hot).select(*on, F.lit(True).alias("_hot"))), on, "left")
    dealt = marked.withColumn("_part", F.when(F.col("_hot"), F.pmod("_part", F.lit(SPREAD)).cast("int")).otherwise(0)).drop("_hot")
    return dealt.join(each, [*on, "_part"], how).drop("_part")


def maybe_in(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """`rows` with `_maybe`: false only where no row of stored `keys` has the same value of `on`; null is in no table.

    Hashes of the keys are set in a filter of FILTER_BITS bits, built by partial aggregation and broadcast, a size that no
    input changes. A filter that fills up tells fewer rows apart and never a wrong one."""
    bit = F.pmod(F.xxhash64(on), F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(bit)
    maps = keys.where(F.col(on).isNotNull()).groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_bucket", F.when(F.col(on).isNotNull(), F.bitmap_bucket_number(bit))).join(F.broadcast(maps), "_bucket", "left")
    return held.withColumn("_maybe", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_map")


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs whose results are stored: Spark removes them when the driver collects garbage,
    which may otherwise be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int]]:
    """Row ranges (start, end) of a batch with at most SLICE_ROWS rows and about SLICE_BYTES of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, batch.num_rows
    while start < n:
        base = sizes[start - 1] if start else 0
        end = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right"))))
        yield start, end
        start = end


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8, null as empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()
