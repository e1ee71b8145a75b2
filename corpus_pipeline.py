"""A corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage reads what the one before kept, as Parquet, and its decisions take effect: rejected documents go, one document of
each class of near-duplicates stays, secrets are cut out of texts, and what is left is packed into sequences. All
but the last return the columns of documents.

Defined cases: a null or empty text fails the quality rules; of rows that are copies, or repeat a key with equal text, one stays, and rows that repeat a key
with different texts all stay; null keys and hosts are values like others; ties go to the least key, then the least content; extra columns are carried, whatever
their names; texts of any length are read whole; an empty table passes through every stage and gives an empty packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, near_dedup, packing, quality, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(spark, docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(spark, docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", one_of_near_duplicates),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Token ids and their packing have no SQL form, so the last stage has none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.keep(spark, stage(spark, docs, sf_dir), name)
    return docs
