"""The queries of the text operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from poolwright.llm import centroids, decontaminate, infill, langid, media, metrictree, packing, pii, quality, secrets, sharding, simhash, substrings
from poolwright.llm.common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store_text(table(spark, sf_dir, "documents")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.query(table(spark, sf_dir, "embeddings"))


def op12_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrictree.query(table(spark, sf_dir, "embeddings"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media, op2_sharding, op3_secrets, op4_substrings, op5_decontaminate, op6_pii, op7_packing, op8_quality, op9_language, op10_simhash, op11_centroids, op12_mtree, op13_infill)
} | {"pipeline": corpus_pipeline.run}
#: The others' hashes, models and whole-text scans have no SQL form that DuckDB can run; tests hold them against brute force.
ORACLES: dict[str, str] = {"op11_centroids": centroids.oracle(), "op12_mtree": metrictree.ORACLE, "op13_infill": infill.ORACLE}
