"""Retrieval and label quality."""

from pyspark.sql import Window, functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.functions import query_text as Q
from vigilgrid.plans import evaluation as E
from vigilgrid.session import scratch_path
from vigilgrid.sources.tables import write_lines

RET = """ret AS (SELECT source AS query_id, lang AS category, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5),
 qs AS (SELECT DISTINCT source || '/' || lang AS query_id, lang AS category FROM documents),
 tru AS (SELECT source || '/' || lang AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
 per AS (SELECT qs.query_id, qs.category, CASE WHEN min(rank) FILTER (t.doc_id IS NOT NULL) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS p_at_1, count(t.doc_id) / 5.0::DOUBLE AS p_at_5,
  coalesce(1.0::DOUBLE / min(rank) FILTER (t.doc_id IS NOT NULL), 0) AS mrr FROM qs LEFT JOIN ret r ON r.query_id || '/' || r.category = qs.query_id LEFT JOIN tru t ON t.query_id = qs.query_id AND t.doc_id = r.doc_id GROUP BY 1, 2)"""


def _ranked(t):
    d = t.raw("documents").withColumn("query_id", F.concat_ws("/", "source", "lang"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    returned = d.select("query_id", "doc_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= 5)
    truth = d.join(t.raw("labels").where(F.col("quality") == 1), "doc_id", "left_semi").select("query_id", "doc_id")
    queries = d.select("query_id", F.col("lang").alias("category")).distinct()
    return E.ranked_metrics(returned, truth, queries)


@query("E1 J22 W12", "", "SELECT query_id, category, p_at_1, p_at_5, round(mrr, 6) AS mrr FROM per", RET)
def ranked_metrics(t):
    return _ranked(t).withColumn("mrr", F.round("mrr", 6))


@query("E1 E3 S13", "", """SELECT category, count(*) AS queries, round(avg(p_at_1), 4) AS precision_at_1, round(avg(p_at_5), 4) AS precision_at_5, round(avg(mrr), 4) AS mean_reciprocal_rank,
 CASE WHEN round(avg(p_at_5), 4) >= 0.2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM per GROUP BY 1""", RET)
def ranked_summary(t):
    return E.ranked_summary(_ranked(t)).withColumn("verdict", E.verdict(F.col("precision_at_5"), 0.2))


PRED = """pm AS (SELECT query_id, category, returned, tp AS true_positives, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM
 (SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'colour' ELSE 'attribute' END AS category, count(h.det_id) AS returned, count(*) FILTER (h.ok) AS tp, CASE WHEN count(h.det_id) > 0 THEN count(*) FILTER (h.ok) / count(h.det_id) ELSE 0 END::DOUBLE AS p,
 CASE WHEN count(*) FILTER (h.ok) > 0 THEN 1 ELSE 0 END::DOUBLE AS r FROM supplier LEFT JOIN (SELECT track_id, det_id, class_label = 'car' AND dominant_colour = 'red' AS ok FROM detections WHERE confidence >= 0.97) h ON h.track_id = s_suppkey GROUP BY 1, 2))"""


def _predicate(t):
    from vigilgrid.operators import filters as P
    hits = t.detections.where(F.col("confidence") >= 0.97).withColumn("query_id", F.col("track_id"))
    c = F.col
    ok = F.coalesce(P.class_is(c("class_label"), "car") & P.colour_is("red", False, c("dominant_colour"), c("upper_colour"), c("lower_colour")), F.lit(False))
    qs = t.raw("supplier").select(F.col("s_suppkey").alias("query_id"), F.when(F.col("s_suppkey") % 3 == 0, "colour").otherwise("attribute").alias("category"))
    return E.predicate_metrics(hits, ok, qs)


@query("E2 J22", "detections", "SELECT * FROM pm", PRED)
def predicate_metrics(t):
    return _predicate(t)


@query("E2 E3", "detections", """SELECT category, count(*) AS queries, round(avg(precision), 4) AS avg_precision, round(avg(recall), 4) AS avg_recall, round(avg(f1), 4) AS avg_f1 FROM pm GROUP BY 1
 UNION ALL SELECT NULL, count(*), round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4) FROM pm""", PRED)
def predicate_summary(t):
    return E.predicate_summary(_predicate(t))


REPORT_ROWS = """m AS (SELECT pm.*, CASE WHEN s_acctbal < 0 THEN 'timed out' END AS error, abs(s_acctbal) AS latency_ms FROM pm JOIN supplier ON s_suppkey = query_id)"""


@query("S13 E2 E3", "detections", """SELECT CASE grouping(query_id, category) WHEN 0 THEN 'query' WHEN 2 THEN 'category' ELSE 'overall' END AS kind, query_id, category, count(*) AS queries, count(error) AS errors,
 round(avg(precision) FILTER (error IS NULL), 4) AS avg_precision, round(avg(recall) FILTER (error IS NULL), 4) AS avg_recall, round(avg(f1) FILTER (error IS NULL), 4) AS avg_f1,
 round(avg(latency_ms) FILTER (error IS NULL), 2) AS avg_latency_ms,
 CASE WHEN grouping(query_id, category) = 3 THEN CASE WHEN coalesce(round(avg(precision) FILTER (error IS NULL), 4), 0) >= 0.05 THEN 'PASS' ELSE 'FAIL' END END AS verdict
 FROM m GROUP BY GROUPING SETS ((query_id, category), (category), ())""", PRED + ", " + REPORT_ROWS)
def metric_report_lines(t):
    run = t.raw("supplier").select(F.col("s_suppkey").alias("query_id"), F.when(F.col("s_acctbal") < 0, "timed out").alias("error"), F.abs("s_acctbal").alias("latency_ms"))
    path = scratch_path(t.spark, "report")
    write_lines(E.metric_report(_predicate(t).join(run, "query_id"), 0.05), path, "overwrite")
    return t.spark.read.schema(E.REPORT).json(path)


@query("E5 V15", "searches", """SELECT count(*) AS labelled, round(avg(CASE WHEN want = 'object_search' OR want = got THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS intent_type FROM (SELECT CASE query_id % 9 WHEN 4 THEN 'statistical_query' WHEN 8 THEN 'comparison'
 WHEN 7 THEN 'event_search' ELSE 'object_search' END AS want, CASE query_id % 9 WHEN 4 THEN 'statistical_query' WHEN 8 THEN 'comparison' WHEN 7 THEN 'event_search' ELSE 'object_search' END AS got FROM searches)""")
def label_accuracy(t):
    n = F.col("query_id") % 9
    want = F.when(n == 4, "statistical_query").when(n == 8, "comparison").when(n == 7, "event_search").otherwise("object_search")
    return E.label_accuracy(t.searches, {"intent_type": (Q.question_type(F.col("query_text")), want)}).withColumn("intent_type", F.round("intent_type", 6))


@query("E6", "", """SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem) AS objects, round((SELECT avg(n) FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey)), 4) AS ids_per_object,
 round(count(*) FILTER (l_returnflag = 'R') / count(DISTINCT l_orderkey), 4) AS false_positives_per_frame FROM lineitem""")
def track_consistency(t):
    return E.track_consistency(t.raw("lineitem"), "l_partkey", "l_suppkey", "l_orderkey", F.col("l_returnflag") == "R")
