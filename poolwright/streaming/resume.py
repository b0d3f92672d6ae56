"""Resumable generation and running metrics; event-time windows for event tables.

A run that stops goes on where its checkpoint says: input files that are done are not read again, and the file sink commits
whole batches. What is left can also be told by id, which doesn't depend on file order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from poolwright.functions.answers import answer_facts, answers_match, facts_match
from poolwright.operators.texts import with_array_facts


def pending(dataset: DataFrame, done: DataFrame, by: str = "example_id") -> DataFrame:
    """Rows of the dataset whose id the output lacks."""
    return dataset.join(done.select(by), by, "left_anti")


def run_resumable(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Applies `work` to the JSON Lines files of `source` that weren't done before and appends JSON Lines to `output`; ends
    when no file is left."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = work(rows).writeStream.format("json").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress(query: StreamingQuery) -> list[dict]:
    """Batch, input rows and seconds of each step of a run."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000} for p in query.recentProgress]


def observed(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """`rows` with counters of candidates and of right first ones and pools, filled while an action runs."""
    o = Observation(name)
    ok = F.transform("candidates", lambda c: answers_match(c, F.col("gold_answer"), F.col("answer_mode")))
    marked = rows.withColumn("_ok", ok)
    watched = marked.observe(o, F.count("*").alias("examples"), F.sum(F.size("candidates")).alias("candidates"), F.count_if(F.coalesce(F.get("_ok", F.lit(0)), F.lit(False))).alias("first_correct"), F.count_if(F.exists("_ok", lambda x: x)).alias("oracle_correct"))
    return watched.drop("_ok"), o


def running_metrics(rows: DataFrame, by: str = "answer_mode", texts: DataFrame | None = None) -> DataFrame:
    """Running counts of a stream (or a table) of pools; write it in complete or update mode. `texts`: rows (c) with all candidates
    of a table, if some are cheaper to make than pools."""
    read = with_array_facts(rows, "candidates", [], lambda c: {"read": answer_facts(c)}, texts)
    ok = F.transform("_facts", lambda x: facts_match(x["read"], F.col("gold_answer"), F.col("answer_mode")))
    marked = read.select(by, ok.alias("ok"))
    return marked.groupBy(by).agg(F.count("*").alias("examples"), F.count_if(F.coalesce(F.get("ok", F.lit(0)), F.lit(False))).alias("first_correct"), F.count_if(F.exists("ok", lambda x: x)).alias("oracle_correct"))


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by type and event-time window; works on streams (late rows beyond `late` are left out) and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def event_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of a stream without those that come again within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
