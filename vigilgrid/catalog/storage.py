"""Sources and sinks: every query writes a table to the shared folder and reads it back."""

from pyspark.sql import functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.session import scratch_path
from vigilgrid.sources import tables as S
from vigilgrid.sources.schemas import TABLES
from vigilgrid.sources.standin import AS_OF_MS


@query("S1 P1", "alerts", "SELECT CAST(id AS VARCHAR) AS id, event_type, severity, metadata FROM alerts WHERE org_id = 2")
def typed_scan(t):
    root = scratch_path(t.spark, "typed")
    cols = [c.strip().split(" ") for c in TABLES["events"].split(",")]
    a = t.alerts.withColumn("end_time", F.col("start_time")).drop("value", "k", "start_ms", "user_id")
    have = set(a.columns)
    typed = a.select(*[(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in cols])
    typed.write.parquet(f"{root}/events")
    return S.scan(t.spark, root, "events", org="2", tenant=True).select("id", "event_type", "severity", "metadata")


@query("S2 S8 P8", "segments", """SELECT segment_id, org_id || '/' || camera_id || '/' || strftime(start_time, '%Y/%m/%d') || '/' || segment_id || '.mp4' AS s3_key, month FROM segments
 WHERE start_time BETWEEN TIMESTAMP '1997-02-10' AND TIMESTAMP '1997-05-20'""")
def segments_by_month(t):
    path = scratch_path(t.spark, "segments")
    S.register_segments(t.segments.drop("month"), path)
    return S.segments_between(t.spark, path, "1997-02-10 00:00:00", "1997-05-20 00:00:00").select(
        "segment_id", "s3_key", F.col("month").cast("string").alias("month"))


@query("S3", "crops", "SELECT crop_id, camera_id, len(embedding) AS dim FROM crops WHERE camera_id = 3")
def vectors_by_camera(t):
    path = scratch_path(t.spark, "vectors")
    S.write_collection(t.crops.select("crop_id", "camera_id", "embedding"), path)
    return t.spark.read.parquet(path).where(F.col("camera_id") == 3).select(
        "crop_id", F.col("camera_id").cast("long").alias("camera_id"), F.size("embedding").cast("long").alias("dim"))


@query("S4 D4", "crops", f"SELECT crop_id, 2 AS version FROM crops WHERE {AS_OF_MS} - frame_id * 1000 * 3600 >= {AS_OF_MS} - 86400000")
def versioned_collection(t):
    root = scratch_path(t.spark, "collections")
    rows = t.crops.select("crop_id", "camera_id", (F.lit(AS_OF_MS) - F.col("frame_id") * 3_600_000).alias("timestamp_ms"))
    S.publish_version(rows.withColumn("version", F.lit(1)), root, "dev_frame_embeddings", 1)
    S.publish_version(rows.withColumn("version", F.lit(2)), root, "dev_frame_embeddings", 2)
    S.unexpired(t.spark.table("dev_frame_embeddings"), "timestamp_ms", 86_400, AS_OF_MS).select("crop_id", "version").write.parquet(f"{root}/live")
    S.retire(t.spark, "dev_frame_embeddings")
    return t.spark.read.parquet(f"{root}/live")


@query("S5", "boxes", "SELECT camera_id, frame_id, count(*) AS detections, round(sum(score), 4) AS score FROM boxes GROUP BY 1, 2")
def frame_metadata_lines(t):
    path = scratch_path(t.spark, "frames")
    S.write_lines(S.frame_records(t.boxes, "camera_id", "frame_id", "frame_id", ["det_id", "class_label", "score"]), path)
    back = t.spark.read.schema("camera_id bigint, frame_id bigint, detections array<struct<det_id:bigint,score:double>>").json(path)
    return back.select("camera_id", "frame_id", F.size("detections").cast("long").alias("detections"),
                       F.round(F.aggregate("detections", F.lit(0.0), lambda a, d: a + d["score"]), 4).alias("score"))


@query("S6", "searches", "SELECT query_id, user_id, results_count FROM searches UNION ALL SELECT query_id, user_id, results_count FROM searches WHERE results_count = 0")
def audit_lines(t):
    path = scratch_path(t.spark, "audit")
    rows = t.searches.select("query_id", "user_id", "query_text", "results_count", "latency_ms")
    S.write_lines(rows, path)
    S.write_lines(rows.where(F.col("results_count") == 0), path)
    return t.spark.read.schema("query_id bigint, user_id bigint, results_count bigint").json(path)


@query("S7", "detections", "SELECT det_id, class_label, confidence, CAST(NULL AS VARCHAR) AS nested FROM detections WHERE confidence > 0.9")
def exported_csv(t):
    path = scratch_path(t.spark, "export")
    hits = t.detections.where(F.col("confidence") > 0.9).select("confidence", "det_id", "class_label", F.struct("bbox_x", "bbox_y").alias("raw_labels"))
    S.export_results(hits, path, "csv")
    back = t.spark.read.option("header", True).schema("class_label string, confidence double, det_id bigint").csv(path)
    return back.select("det_id", "class_label", "confidence", F.lit(None).cast("string").alias("nested"))


@query("S7", "detections", "SELECT det_id, round(bbox_x, 6) AS x FROM detections WHERE confidence > 0.9")
def exported_json(t):
    path = scratch_path(t.spark, "export")
    S.export_results(t.detections.where(F.col("confidence") > 0.9).select("det_id", F.struct("bbox_x", "bbox_y").alias("raw_labels")), path)
    return t.spark.read.schema("det_id bigint, raw_labels struct<bbox_x:double>").json(path).select("det_id", F.round("raw_labels.bbox_x", 6).alias("x"))


@query("S9", "boxes", """SELECT det_id, camera_id || '/' || CASE WHEN frame_id % 4 = 0 THEN 'untracked' ELSE 'track_' || frame_id % 50 END || '/' || frame_id || '_' || class_label || '_' || CAST(round(CAST(score AS DECIMAL(10, 4)), 2) AS DECIMAL(10, 2)) || '.jpg' AS crop_path FROM boxes""")
def crop_manifest(t):
    b = t.boxes.withColumn("track_id", F.when(F.col("frame_id") % 4 != 0, F.col("frame_id") % 50))
    return S.crop_manifest(b, "camera_id", "track_id", "frame_id", "class_label", "score").select("det_id", "crop_path")


@query("S1 S3 J1", "detections segments", "SELECT det_id, camera_id, confidence FROM detections JOIN segments USING (segment_id)")
def bucketed_hits(t):
    return S.joined_buckets(
        S.write_buckets(t.detections.select("det_id", "segment_id", "confidence"), scratch_path(t.spark, "hits"), "segment_id", 16),
        S.write_buckets(t.segments.select("segment_id", "camera_id"), scratch_path(t.spark, "held"), "segment_id", 16), "segment_id").select(
        "det_id", "camera_id", "confidence")
