"""The corpus pipeline: quality rules, exact deduplication, near deduplication, secret scans, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilgrid.llm import exact, jaccard, packing, quality, secrets
from vigilgrid.llm.queries import gpt_encoder
from vigilgrid.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest doc_id."""
    return jaccard.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every reported span masked by asterisks of its length."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1024 tokens."""
    return packing.packed(docs, gpt_encoder).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("ngram_jaccard", near_dedup),
    ("secret_scans", secret_scans), ("packing", packed)]

#: Near duplicates on whole tables and tokenising are beyond SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as a table before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
