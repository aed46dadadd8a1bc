"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilgrid.llm import bpe, exact, html, jaccard, licenses, middle, mil, minhash, packing, phrases, quality, secrets, suffixes
from vigilgrid.llm.registry import QUERIES, SQL, query, table


@query(quality.sql("documents"))
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.marked(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", "_dedup.keep_id", "_dedup.group_size", "_dedup.kept", F.col("_dedup.sha256").alias("text_sha256"))


@query(secrets.sql("documents"))
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "row.doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"))


def gpt_encoder(name: str = "byte_bpe_50k.json"):
    """Builds the encoder inside the task; the vocabulary file is read where the task runs."""
    import public_tokenizers

    return packing.encoder(public_tokenizers.path(name), public_tokenizers.PATTERN)


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), gpt_encoder).withColumnRenamed("doc", "doc_id")


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


@query()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).select(
        "page_id", "url", F.col("_main").alias("text"), F.length("_main").cast("long").alias("n_chars"))


@query()
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil.trained(docs, table(spark, sf_dir, "labels"))
    return mil.scored(docs, model).select(
        F.col("id").alias("doc_id"), mil.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(middle.sql("documents"))
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.transformed(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(middle.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


@query(phrases.sql("documents"))
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
