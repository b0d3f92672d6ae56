"""Readers and writers over files. Paths go to Spark, so any store that Spark reads will do; only reports of bounded size
are written by the driver."""

from __future__ import annotations

import csv
import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_jsonl(spark: SparkSession, path: str, schema: str, position: bool = False) -> DataFrame:
    """JSON Lines under a schema; a malformed line fails the query, blank lines are passed over. With `position`: `pos`
    orders rows by file and place, growing but not gapless, without a shuffle."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn("pos", F.monotonically_increasing_id()) if position else rows


def scan_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file; a top-level array gives a row for each element."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def scan_json_variant(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file as column `doc` (VARIANT), for nested_get."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))


def scan_shards(spark: SparkSession, folder: str, schema: str, pattern: str = "shard_*.jsonl") -> DataFrame:
    """All shards of a folder with `shard` and `_path`, name and path of the file each row is from; order by (shard, pos) for
    their order."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folder)
    return rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("shard"), F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("pos"))


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, all columns strings."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def scan_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def scan_report_metric(spark: SparkSession, path: str, label: str = "accuracy") -> DataFrame:
    """(path, value): the first number after a label in Markdown reports."""
    pattern = rf"(?i){label}\W{{0,12}}([-+]?\d+(?:\.\d+)?)"
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).try_cast("double").alias("value"))


def nested_get(doc: Column, path: str, kind: str = "double") -> Column:
    """A value at a dotted path of a VARIANT, null where there is none."""
    return F.try_variant_get(doc, "$." + path, kind)


def first_number(doc: Column, paths: list[str], label: str) -> Column:
    """The first number among several paths; the query fails where no path has one."""
    return F.coalesce(*[nested_get(doc, p) for p in paths], F.raise_error(F.lit(f"no number for {label}")).cast("double"))


def sink_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON Lines parts; an output that is there already is not touched unless `mode` says so. Null fields are
    written, so every line has all keys."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def sink_csv(rows: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    rows.select(*fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def sink_parquet(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).parquet(path)


def write_atomic(path: str | Path, text: str) -> None:
    """A report of the driver: a temporary file in the same folder, then renamed over the target."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def write_json(path: str | Path, payload: object) -> None:
    write_atomic(path, json.dumps(payload, indent=2, ensure_ascii=False, default=str) + "\n")


def one_row(rows: DataFrame) -> dict:
    """A one-row report as a dict; more than one row is an error."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"a report has one row, not {len(found)}")
    return found[0].asDict(recursive=True)


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, md5) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def fingerprint_ids(rows: DataFrame, ids: str = "example_id", position: str = "pos", *by: str) -> DataFrame:
    """(by, n, sha1): SHA-1 of the ids joined by newlines in their order. One row holds all ids of a group, so it is for id
    lists, such as a slice, not for whole corpora; use fingerprint_set for those."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(ids).alias("i")))), lambda x: x["i"].cast("string"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha1(F.array_join(ordered, "\n")).alias("sha1"))


#: Hexadecimal digits of SHA-256 that a lane of a fingerprint has, and how many lanes there are.
LANE, LANES = 15, 4


def fingerprint_set(rows: DataFrame, *facts: str) -> DataFrame:
    """(n, lanes array<long>): an order-free fingerprint of any number of rows: the SHA-256 of each row's facts (SQL
    expressions, as text; null as \\N), summed lane by lane modulo 16**LANE. Rows that repeat count as often as they occur, the same rows
    give the same fingerprint however they are partitioned, and fingerprint_sum() adds or takes away rows."""
    text = F.concat_ws(chr(31), *[F.coalesce(F.expr(c).cast("string"), F.lit("\\N")) for c in facts])
    h = F.sha2(text, 256)
    lane = lambda i: F.sum(F.conv(F.substring("h", LANE * i + 1, LANE), 16, 10).cast("decimal(38,0)"))
    kept = lambda s: F.coalesce(s % F.lit(16**LANE).cast("decimal(38,0)"), F.lit(0)).cast("long")
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.array(*[kept(lane(i)) for i in range(LANES)]).alias("lanes"))


def fingerprint_sum(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """The fingerprint of the rows of `a` and `b` together, or with `sign` -1 of those of `a` without those of `b`."""
    both = a.join(F.broadcast(b.select(F.col("n").alias("_n"), F.col("lanes").alias("_lanes"))))  # one row each
    return both.select((F.col("n") + sign * F.col("_n")).alias("n"), F.zip_with("lanes", "_lanes", lambda x, y: F.pmod(x + sign * y, F.lit(16**LANE))).alias("lanes"))


def fingerprint_text(of: DataFrame) -> DataFrame:
    """(n, digest): the lanes as hexadecimal digits."""
    return of.select("n", F.array_join(F.transform("lanes", lambda x: F.lpad(F.lower(F.hex(x)), LANE, "0")), "").alias("digest"))


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with those of `new` in place of the rows of the same keys, appended otherwise; columns widen."""
    return rows.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_csv(path: str | Path, fields: list[str], row: dict, keys: list[str]) -> None:
    """upsert() for a small CSV file of the driver."""
    path, rows = Path(path), []
    if path.exists():
        with path.open(newline="", encoding="utf-8") as f:
            rows = list(csv.DictReader(f))
    columns = list(dict.fromkeys([*fields, *(c for r in rows for c in r), *row]))
    same = [i for i, r in enumerate(rows) if all(str(r.get(k, "")) == str(row.get(k, "")) for k in keys)]
    rows = [r for i, r in enumerate(rows) if i not in same[1:]]
    if same:
        rows[same[0]] = rows[same[0]] | row
    else:
        rows.append(row)
    out = [",".join(columns)] + [",".join('"' + str(r.get(c, "")).replace('"', '""') + '"' if any(x in str(r.get(c, "")) for x in ',"\n') else str(r.get(c, "")) for c in columns) for r in rows]
    write_atomic(path, "\n".join(out) + "\n")


def upsert_section(path: str | Path, title: str, body: str) -> None:
    """The text under `## title` of a Markdown file replaced, or the section appended."""
    path = Path(path)
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    lines, out, inside, done = text.splitlines(), [], False, False
    for line in lines:
        if line.startswith("## "):
            inside = line[3:].strip() == title
            if inside:
                out += [line, "", body.strip(), ""]
                done = True
                continue
        if not inside:
            out.append(line)
    if not done:
        out += ([""] if out and out[-1] else []) + [f"## {title}", "", body.strip(), ""]
    write_atomic(path, "\n".join(out).rstrip("\n") + "\n")


def upsert_json_field(path: str | Path, key: str, value: object, note: str | None = None) -> None:
    """Sets a key of a JSON document; adds `note` to its notes unless it is there."""
    path = Path(path)
    doc = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    doc[key] = value
    if note and note not in doc.setdefault("notes", []):
        doc["notes"].append(note)
    write_json(path, doc)


def stage(rows: DataFrame, target: str, refresh: bool = False) -> DataFrame:
    """A table at `target`, written there first unless it exists or `refresh` asks for it anew."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if refresh or not there:
        rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local master
    gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="poolwright-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/poolwright/{name}-{uuid.uuid4().hex}"
