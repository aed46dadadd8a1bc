"""Retrieval and labelling quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_relevant_rank(ranked: DataFrame, by: list[str], score: str, id_col: str) -> DataFrame:
    """Rank of the first relevant row per group, null without one.

    The rank is one plus the rows that beat the best relevant row, so no group is ever sorted.
    """
    order = F.struct(F.col(score), -F.col(id_col))
    best = ranked.where("relevant").groupBy(*by).agg(F.max(order).alias("_best"))
    ahead = ranked.join(best, by, "left").groupBy(*by).agg(
        F.count_if(order > F.col("_best")).alias("_n"), F.max("_best").alias("_any"))
    return ahead.select(*by, F.when(F.col("_any").isNotNull(), F.col("_n") + 1).alias("rank"))


def ranked_metrics(returned: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """P@1, P@k (always over k) and reciprocal rank per query.

    ``returned``: query_id, rank, doc_id; ``truth``: query_id, doc_id; ``queries``: query_id, category.
    A query without truth or answers scores 0.
    """
    hits = returned.join(truth.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    per = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    return queries.join(per, "query_id", "left").select(
        "query_id", "category", F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("p_at_1"),
        F.coalesce(F.col("n") / F.lit(float(k)), F.lit(0.0)).alias("p_at_5"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def ranked_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("category").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("p_at_1"), 4).alias("precision_at_1"),
        F.round(F.avg("p_at_5"), 4).alias("precision_at_5"), F.round(F.avg("mrr"), 4).alias("mean_reciprocal_rank"))


def predicate_metrics(hits: DataFrame, matches: Column, queries: DataFrame) -> DataFrame:
    """Precision, 0/1 recall and F1 per query from hits judged by a predicate."""
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.count_if(matches).alias("true_positives"))
    q = queries.join(per, "query_id", "left").fillna(0, ["returned", "true_positives"])
    p = F.when(F.col("returned") > 0, F.col("true_positives") / F.col("returned")).otherwise(0.0)
    r = F.when(F.col("true_positives") > 0, 1.0).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return q.select("query_id", "category", "returned", "true_positives", F.round(p, 4).alias("precision"),
                    F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def predicate_summary(metrics: DataFrame) -> DataFrame:
    """Means per category and over all (category null); queries with an error are left out."""
    ok = metrics.where(F.col("error").isNull()) if "error" in metrics.columns else metrics
    means = [F.count(F.lit(1)).alias("queries")] + [F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("precision", "recall", "f1")]
    return ok.groupBy("category").agg(*means).unionByName(
        ok.agg(*means).withColumn("category", F.lit(None).cast("string")))


REPORT = ("kind string, query_id bigint, category string, queries bigint, errors bigint, avg_precision double, avg_recall double, avg_f1 double, "
          "avg_latency_ms double, verdict string")


def metric_report(metrics: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Records of a report by ``kind``: one per query, one per category, one overall with the verdict.

    ``metrics``: query_id, category, precision, recall, f1, latency_ms, error. One pass with grouping sets; queries with an error count as
    errors and enter no mean. Without a valid query means are null and the overall record fails. No queries give no records.
    """
    ok = F.col("error").isNull()
    means = [F.round(F.avg(F.when(ok, F.col(c))), 4).alias(f"avg_{c}") for c in ("precision", "recall", "f1")]
    grouped = metrics.groupingSets([["query_id", "category"], ["category"], []], "query_id", "category").agg(
        F.grouping_id("query_id", "category").alias("level"), F.count(F.lit(1)).alias("queries"), F.count_if(~ok).alias("errors"), *means,
        F.round(F.avg(F.when(ok, F.col("latency_ms"))), 2).alias("avg_latency_ms"))
    kind = F.when(F.col("level") == 0, "query").when(F.col("level") == 2, "category").otherwise("overall")
    passed = verdict(F.coalesce(F.col("avg_precision"), F.lit(0.0)), threshold)
    return grouped.select(kind.alias("kind"), "query_id", "category", "queries", "errors", "avg_precision", "avg_recall", "avg_f1", "avg_latency_ms",
                          F.when(kind == "overall", passed).alias("verdict"))


def verdict(value: Column, threshold: float = 0.80) -> Column:
    return F.when(value >= threshold, "PASS").otherwise("FAIL")


def neighbour_recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours the approximate search also returned."""
    both = approximate.select("probe_id", "candidate_id").withColumn("found", F.lit(1))
    return exact.join(both, ["probe_id", "candidate_id"], "left").agg(
        F.avg(F.coalesce("found", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("neighbours"))


def label_accuracy(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Share of rows where predicted equals expected (null equals null), per named pair."""
    return df.agg(F.count(F.lit(1)).alias("labelled"), *[
        F.avg(F.when(a.eqNullSafe(b), 1.0).otherwise(0.0)).alias(n) for n, (a, b) in pairs.items()])


def track_consistency(assignments: DataFrame, obj: str, track: str, frame: str, is_false: Column) -> DataFrame:
    """Distinct track ids per true object and false positives per frame."""
    ids = assignments.where(F.col(obj).isNotNull()).select(obj, track).distinct().groupBy(obj).agg(
        F.count(F.lit(1)).alias("ids"))
    n_frames = assignments.select(frame).distinct().agg(F.count(F.lit(1)).alias("frames")).withColumn("_one", F.lit(1))
    false = assignments.agg(F.count_if(is_false).alias("false_positives")).withColumn("_one", F.lit(1))
    return (ids.agg(F.count(F.lit(1)).alias("objects"), F.avg("ids").alias("ids_per_object")).withColumn("_one", F.lit(1))
            .join(n_frames, "_one").join(false, "_one").select(
        "objects", F.round("ids_per_object", 4).alias("ids_per_object"),
        F.round(F.col("false_positives") / F.col("frames"), 4).alias("false_positives_per_frame")))
