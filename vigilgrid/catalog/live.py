"""Streams run over the driver's files until drained, then read back from their sink."""

from pyspark.sql import functions as F

from vigilgrid.catalog.analytics import HOURLY, KPI_SQL, ORG, SEARCHES
from vigilgrid.catalog.alerting import ABANDON, CROWD, DAY, FIGHT, HOUR, KEPT, LOCKS, LOITER, STEP, ZONES, suppressed_sql
from vigilgrid.catalog.joining import meets_sql, ring_sql
from vigilgrid.catalog.registry import query
from vigilgrid.catalog.shapes import SKETCH, TRACKER, crop_vectors, shown_tracks, timed_boxes
from vigilgrid.plans import alerts as A, reports as P
from vigilgrid.session import scratch_path
from vigilgrid.sources.standin import AS_OF, VIEWS
from vigilgrid.streaming import chains as C, rollups as R, sources as S, stateful as T

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t):
    """The events table as a stream in the shape of the alerts view, with event time ``ts``."""
    raw = S.file_stream(t.spark, f"{t.sf_dir}/events.parquet", EVENTS)
    raw.createOrReplaceTempView("live_events_source")
    text = VIEWS["alerts"][0].replace("{events}", "live_events_source")
    return t.spark.sql(text).withColumn("ts", F.col("start_time").cast("timestamp")).withColumn("ts_ms", F.col("start_ms"))


def _points(t):
    e = _events(t)
    cls = F.element_at(F.array(*[F.lit(c) for c in (0, 0, 0, 26, 2)]), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select("camera_id", F.col("user_id").alias("track_id"), cls.alias("class_id"), "ts", "ts_ms", F.col("value").alias("cx"), F.col("k").cast("double").alias("cy"))


def _drained(t, df, mode="append", store=None):
    out = scratch_path(t.spark, "stream")
    R.run(df, f"{out}/data", f"{out}/checkpoint", mode, store)
    return t.spark.read.schema(df.schema).parquet(f"{out}/data")


def _latest(t, df, keys):
    """Update-mode result: the newest batch's row per group."""
    out = scratch_path(t.spark, "feed")
    R.drained(R.upsert_latest(df, f"{out}/data", f"{out}/checkpoint", every=None))
    rows = t.spark.read.parquet(f"{out}/data")
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


@query("T15 A1", "alerts", """SELECT * FROM (SELECT date_trunc('hour', start_time) AS bucket, org_id, camera_id, event_type, severity, count(*) AS event_count FROM alerts GROUP BY ALL)
 WHERE epoch_ms(bucket) + 3600000 <= (SELECT max(start_ms) FROM alerts) - 7200000""")
def live_events_hourly(t):
    return _drained(t, R.events_hourly(_events(t))).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("S12 T15 A5", "alerts", "SELECT date_trunc('hour', start_time) AS bucket, org_id, camera_id, event_type, severity, count(*) AS event_count FROM alerts GROUP BY ALL")
def live_kpi_feed(t):
    keys = ["bucket", "org_id", "camera_id", "event_type", "severity"]
    return _latest(t, R.events_hourly(_events(t)), keys).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("S12 T15 A5 A6 A7 A8", "alerts cameras searches", KPI_SQL, f"{HOURLY}, {SEARCHES}")
def live_kpis(t):
    """The five values of the feed from three kept rollups, at the moment that stands for now."""
    lines = t.raw("part")
    S.file_stream(t.spark, f"{t.sf_dir}/part.parquet", ", ".join(f"{c} {k}" for c, k in lines.dtypes)).createOrReplaceTempView("live_parts_source")
    searches = t.spark.sql(VIEWS["searches"][0].replace("{part}", "live_parts_source")).withColumn("ts", F.col("created_at").cast("timestamp"))
    kept = []
    for rollup, keys in ((R.events_hourly(_events(t)), ["org_id", "camera_id", "event_type", "severity"]), (R.searches_by_second(searches), ["org_id"]),
                         (R.searches_hourly(searches), ["org_id"])):
        out = scratch_path(t.spark, "kept")
        table = R.KeptTable(t.spark, f"{out}/data", keys)
        R.drained(table.keep(rollup, f"{out}/checkpoint", every=None))
        kept.append(table.rows().withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))
    return P.kept_kpis(t.cameras, *kept, ORG, AS_OF)


@query("T15 A4", "health", """SELECT date_trunc('hour', ts) AS bucket, org_id, camera_id, round(avg(CASE WHEN uptime_status = 'online' THEN 1.0::DOUBLE ELSE 0 END), 6) AS uptime_ratio,
 round(avg(frame_drop_rate), 6) AS avg_frame_drop_rate, round(avg(detection_latency_ms), 6) AS avg_detection_latency_ms FROM health GROUP BY ALL""")
def live_health_hourly(t):
    e = _events(t).select("ts", "org_id", "camera_id", F.when(F.col("event_type") == "error", "offline").otherwise("online").alias("uptime_status"),
                          (F.col("value") / 10.0).alias("frame_drop_rate"), (F.col("value") + 100.0).alias("detection_latency_ms"))
    out = _latest(t, R.health_hourly(e), ["bucket", "org_id", "camera_id"])
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "org_id", "camera_id", *[F.round(c, 6).alias(c) for c in ("uptime_ratio", "avg_frame_drop_rate", "avg_detection_latency_ms")])


@query("T15 A2", "alerts", """SELECT date_trunc('hour', start_time) AS bucket, org_id, count(*) AS query_count, round(avg(user_id), 6) AS avg_latency_ms,
 count(*) FILTER (k < 20) AS zero_results_count FROM alerts GROUP BY ALL""")
def live_searches_hourly(t):
    e = _events(t).select("ts", "org_id", F.col("user_id").cast("double").alias("latency_ms"), F.when(F.col("k") >= 20, F.col("k")).otherwise(0).alias("results_count"))
    out = _latest(t, R.searches_hourly(e), ["bucket", "org_id"])
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "org_id", "query_count", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "zero_results_count")


@query("T15 A3", "alerts", "SELECT date_trunc('day', start_time) AS bucket, org_id, event_type AS class_label, count(*) AS object_count FROM alerts GROUP BY ALL")
def live_detections_daily(t):
    e = _events(t).select("ts", "org_id", F.col("event_type").alias("class_label"))
    return _latest(t, R.detections_daily(e), ["bucket", "org_id", "class_label"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("T1", "alerts", KEPT, suppressed_sql("cand AS (SELECT camera_id, event_type AS zone_id, start_ms AS ts_ms FROM alerts)", 6 * HOUR))
def live_suppressed_alerts(t):
    rows = _events(t).select("camera_id", F.col("event_type").alias("zone_id"), "ts", "ts_ms")
    return _drained(t, T.suppress(rows, ["camera_id", "zone_id"], 6 * HOUR))


def _rules(t, rules):
    found = _drained(t, T.rule_alerts(_points(t), rules, ttl_ms=10 * DAY))
    out = scratch_path(t.spark, "rules")
    found.write.parquet(out)
    again = S.file_stream(t.spark, out, "camera_id bigint, track_id bigint, event_type string, zone_id string, ts_ms bigint")
    keyed = again.withColumn("ts", F.timestamp_millis("ts_ms"))
    return _drained(t, T.suppress(keyed, ["camera_id", "zone_id"], 6 * HOUR))


@query("T2", "points", KEPT, suppressed_sql(LOITER, 6 * HOUR))
def live_loitering(t):
    return _rules(t, {"zones": ZONES, "dwell_threshold_ms": 12 * HOUR, "detect": ["loitering"]})


@query("T3", "points", KEPT, suppressed_sql(STEP + ", cand AS (SELECT camera_id, 'fence' AS zone_id, ts_ms FROM st WHERE px IS NOT NULL AND " + meets_sql(("px", "py"), ("x", "y"), (30.0, 0.0), (30.0, 100.0))
       + " UNION ALL " + " UNION ALL ".join(f"SELECT camera_id, '{z}', ts_ms FROM st WHERE px IS NOT NULL AND NOT {ring_sql('px', 'py', r)} AND {ring_sql('x', 'y', r)}" for z, r in ZONES.items()) + ")", 6 * HOUR))
def live_perimeter(t):
    return _rules(t, {"zones": ZONES, "lines": {"fence": [(30.0, 0.0), (30.0, 100.0)]}, "detect": ["perimeter_breach"]})


@query("T4", "points", KEPT, suppressed_sql("""mv AS (SELECT *, x - lag(x, 4) OVER w AS mx, y - lag(y, 4) OVER w AS my FROM points WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_ms)),
 cand AS (SELECT camera_id, '' AS zone_id, ts_ms FROM mv WHERE mx IS NOT NULL AND sqrt(mx^2 + my^2) >= 10 AND mx / sqrt(mx^2 + my^2) < cos(radians(90)))""", 6 * HOUR))
def live_wrong_direction(t):
    return _rules(t, {"detect": ["wrong_direction"]})


#: Alerts of moments that the last watermark has passed.
CLOSED = f"{KEPT} AND ts_ms + {6 * HOUR} <= (SELECT max(ts_ms) FROM points) - {2 * HOUR}"


def _alerts(t, chain):
    """Alerts as the batch queries show them, and their metadata."""
    return _drained(t, chain, store=C.STORE).select("camera_id", F.coalesce("zone_id", F.lit("")).alias("zone_id"), "ts_ms")


@query("T6 J14", "points", CLOSED, suppressed_sql(ABANDON.replace("sx < 60 AND sy < 30", "sx < 40 AND sy < 40"), 12 * HOUR))
def live_abandoned(t):
    rules = {"proximity_threshold": 25.0, "stationary_std_threshold": 40.0, "abandoned_time_threshold_ms": 6 * HOUR}
    return _alerts(t, C.abandoned(_points(t), rules, 6 * HOUR, 20.0, 12 * HOUR, 40 * DAY))


@query("T5 G10 A26", "points", CLOSED, suppressed_sql(CROWD, 12 * HOUR))
def live_crowds(t):
    return _alerts(t, C.crowds(_points(t), {"density_threshold": 15.0, "count_threshold": 3}, 6 * HOUR, 640, 480, 12 * HOUR))


@query("T7 J16 W3", "points", CLOSED, suppressed_sql(FIGHT, 12 * HOUR))
def live_fights(t):
    return _alerts(t, C.fights(_points(t), {}, 6 * HOUR, 20.0, 12 * HOUR, 40 * DAY))


@query("T8 W14", "points", """SELECT s.camera_id, s.track_id, s.ts_ms, s.state, s.life_start AS born_ms FROM rec s""", ctes="""o AS (SELECT camera_id, track_id, ts_ms,
 row_number() OVER (PARTITION BY camera_id, track_id ORDER BY ts_ms) AS i FROM points), rec AS (
 SELECT camera_id, track_id, ts_ms, i, 'tentative' AS state, ts_ms AS life_start FROM o WHERE i = 1 UNION ALL
 SELECT o.camera_id, o.track_id, o.ts_ms, o.i,
  CASE WHEN o.ts_ms - r.ts_ms > 86400000 THEN 'tentative' WHEN r.state = 'confirmed' THEN 'confirmed' WHEN o.ts_ms - r.ts_ms <= 21600000 THEN 'confirmed' ELSE 'tentative' END,
  CASE WHEN o.ts_ms - r.ts_ms > 86400000 THEN o.ts_ms WHEN r.state = 'tentative' AND o.ts_ms - r.ts_ms > 21600000 THEN o.ts_ms ELSE r.life_start END
 FROM rec r JOIN o ON o.camera_id = r.camera_id AND o.track_id = r.track_id AND o.i = r.i + 1)""")
def live_track_states(t):
    rows = _points(t).withColumn("score", F.lit(0.5))
    out = _drained(t, T.track_states(rows, 21_600_000, 2, 86_400_000))
    return out.where(F.col("state") != "deleted").select("camera_id", "track_id", "ts_ms", "state", "born_ms")


@query("T8 J11 J12 A25 W14")
def live_tracked_boxes(t):
    """The tracker cascade as stream state over the boxes; its rows are those of ``tracked_boxes`` up to the watermark."""
    lines = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
    S.file_stream(t.spark, f"{t.sf_dir}/lineitem.parquet", ", ".join(f"{c} {k}" for c, k in lines.dtypes)).createOrReplaceTempView("live_lines_source")
    boxes = t.spark.sql(VIEWS["boxes"][0].replace("{lineitem}", "live_lines_source"))
    tracks = C.live_tracks(timed_boxes(t, boxes), TRACKER, ttl_ms=400 * DAY, lateness="10 seconds", vectors=crop_vectors(t))
    return _drained(t, shown_tracks(tracks), store=C.STORE)


@query("T9", "points", """SELECT camera_id, track_id, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE AS dwell_s FROM (SELECT *, sum(n) OVER (PARTITION BY camera_id, track_id ORDER BY ts_ms) AS s FROM
 (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY camera_id, track_id ORDER BY ts_ms) < 43200000 THEN 0 ELSE 1 END AS n FROM points)) GROUP BY camera_id, track_id, s
 HAVING max(ts_ms) + 43200000 <= (SELECT max(ts_ms) FROM points) - 7200000""")
def live_dwell_sessions(t):
    return _drained(t, R.dwell_sessions(_points(t), "12 hours"))


@query("T10", "points", """SELECT camera_id, ts_ms, status FROM (SELECT track_id AS camera_id, ts_ms, 'online' AS status FROM g WHERE prev IS NULL OR ts_ms - prev > 64800000 UNION ALL
 SELECT track_id, prev + 64800001, 'offline' FROM g WHERE ts_ms - prev > 64800000 UNION ALL
 SELECT track_id, max(ts_ms) + 64800001, 'offline' FROM g GROUP BY 1 HAVING max(ts_ms) + 64800001 <= (SELECT max(ts_ms) FROM g) - 7200000)""",
       "g AS (SELECT *, lag(ts_ms) OVER (PARTITION BY track_id ORDER BY ts_ms) AS prev FROM points)")
def live_camera_status(t):
    beats = _points(t).select(F.col("track_id").alias("camera_id"), "ts", "ts_ms")
    return _drained(t, T.camera_silence(beats, 64_800_000))


def _status_sql(window, target, stale, degraded, critical, error_window):
    """Status of every moment, the moments at which silence grew too long, and of both those where the status changes."""
    w, s = "OVER (PARTITION BY cam ORDER BY ts", window / 1000
    ratio = f"n / {s}::DOUBLE / ({target} / {s}::DOUBLE)"
    return f"""mo AS (SELECT *, max(ts) OVER (PARTITION BY cam) AS mx FROM (SELECT user_id AS cam, start_ms AS ts, count(*) FILTER (event_type <> 'error') AS f, count(*) FILTER (event_type = 'error') AS e FROM alerts GROUP BY 1, 2)),
 a AS (SELECT *, sum(e) {w} RANGE BETWEEN {error_window - 1} PRECEDING AND CURRENT ROW) AS errs, max(CASE WHEN f > 0 THEN ts END) {w}) AS lf,
  CASE WHEN f > 0 THEN sum(f) {w} RANGE BETWEEN {window - 1} PRECEDING AND CURRENT ROW) END AS nf FROM mo), b AS (SELECT *, last_value(nf IGNORE NULLS) {w}) AS n FROM a),
 st AS (SELECT cam, ts, 1 AS o, CASE WHEN ts - lf > {stale} THEN 'offline' WHEN errs >= {critical} THEN 'critical' WHEN errs >= {degraded} THEN 'degraded' WHEN n > 1 AND {ratio} < 0.3 THEN 'critical'
  WHEN n > 1 AND {ratio} < 0.7 THEN 'degraded' ELSE 'healthy' END AS status FROM b UNION ALL
  SELECT cam, ts + {stale + 1}, 0, 'offline' FROM (SELECT cam, ts, mx, lead(ts) {w}) AS nx FROM mo WHERE f > 0)
  WHERE nx - ts > {stale} OR nx IS NULL AND (mx - ts > {stale} OR ts + {stale + 1} <= (SELECT max(ts) FROM mo) - {2 * HOUR}))"""


@query("T10", "alerts", "SELECT cam AS camera_id, ts AS ts_ms, status FROM (SELECT *, lag(status) OVER (PARTITION BY cam ORDER BY ts, o) AS before FROM st) WHERE before IS NULL OR before <> status",
       _status_sql(24 * HOUR, 7, 36 * HOUR, 2, 4, 72 * HOUR))
def live_camera_verdicts(t):
    reports = _events(t).select(F.col("user_id").alias("camera_id"), "ts", "ts_ms", (F.col("event_type") == "error").alias("is_error"))
    return _drained(t, T.camera_verdicts(reports, 7 / 86_400, 24 * HOUR, 36 * HOUR, (2, 4), error_window_ms=72 * HOUR, ttl_ms=40 * DAY))


@query("T9", "points", """SELECT camera_id, track_id, min(ts_ms) AS ts_ms, round(min(ts_ms - f) / 1000.0::DOUBLE, 3) AS dwell_s FROM (SELECT *, min(ts_ms) OVER (PARTITION BY camera_id, track_id) AS f FROM points)
 WHERE (ts_ms - f) / 1000.0::DOUBLE > CASE class_id WHEN '0' THEN 1700000 WHEN '2' THEN 2000000 ELSE 2480000 END GROUP BY 1, 2""")
def live_suspicious_dwells(t):
    c = F.col("class_id")
    rows = _points(t).withColumn("class_label", F.when(c == 0, "person").when(c == 2, "car").otherwise("backpack"))
    out = _drained(t, T.dwell_alerts(rows, {"person": 1_700_000.0, "vehicle": 2_000_000.0, "object": 2_480_000.0}, A.VEHICLES, 40 * DAY))
    return out.select("camera_id", "track_id", "ts_ms", F.round("dwell_s", 3).alias("dwell_s"))


@query("T11", "points", """SELECT camera_id, make_timestamp(w * 1000) AS start_time, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS frames FROM (SELECT camera_id, ts_ms, unnest(range((ts_ms // 25200000) * 25200000 - 25200000, ts_ms + 1, 25200000)) AS w FROM points)
 WHERE w <= ts_ms AND ts_ms < w + 28800000 GROUP BY camera_id, w HAVING w + 28800000 <= (SELECT max(ts_ms) FROM points) - 7200000""")
def live_segments(t):
    out = _drained(t, R.segments(_points(t), "ts", 8 * 3600, 3600))
    return out.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


@query("T12", "", "SELECT lang, h AS sketch FROM r WHERE ok", f"""o AS (SELECT lang, doc_id, {SKETCH} AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
 r AS (SELECT lang, i, h, [h] AS kept, true AS ok FROM o WHERE i = 1 UNION ALL SELECT o.lang, o.i, o.h, CASE WHEN f THEN list_append(r.kept, o.h) ELSE r.kept END, f
 FROM r JOIN o ON o.lang = r.lang AND o.i = r.i + 1, LATERAL (SELECT len(list_filter(r.kept[-60:], lambda k: bit_count(xor(k, o.h)) <= 4)) = 0 AS f))""")
def live_distinct_frames(t):
    docs = S.file_stream(t.spark, f"{t.sf_dir}/documents.parquet", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    # A stream's first watermark is the epoch itself, so frame times start well after it.
    ms = F.col("doc_id") * 1000 + 1_600_000_000_000
    rows = docs.select(F.col("lang").alias("camera_id"), ms.alias("ts_ms"), F.timestamp_millis(ms).alias("ts"), F.expr(SKETCH).alias("sketch"))
    return _drained(t, T.distinct_frames(rows, 4, 60)).select(F.col("camera_id").alias("lang"), "sketch")


@query("T13", "alerts", "SELECT user_id, ts AS ts_ms, win AS opened_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, win ORDER BY i) AS n FROM r) WHERE n > 3", f"""o AS (SELECT user_id, start_ms AS ts, row_number() OVER (PARTITION BY user_id ORDER BY start_ms) AS i FROM alerts),
 r AS (SELECT user_id, i, ts, ts AS win FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.ts, CASE WHEN o.ts - r.win >= {DAY} THEN o.ts ELSE r.win END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)""")
def live_rate_limit(t):
    return _drained(t, T.rate_limit(_events(t).select("user_id", "ts", "ts_ms"), 3, DAY))


@query("T14", "alerts", "SELECT user_id, ts AS locked_ms FROM r WHERE locks", LOCKS)
def live_lockouts(t):
    return _drained(t, T.lockouts(_events(t).select("user_id", "ts", "ts_ms"), 5, 3 * DAY, 2 * DAY))


@query("S10", "boxes", "SELECT camera_id, frame_id, count(*) AS detections, round(sum(score), 4) AS score FROM boxes GROUP BY 1, 2")
def live_detection_source(t):
    out = scratch_path(t.spark, "messages")
    det = F.struct(F.col("det_id").alias("track_id"), F.lit(0).alias("class_id"), "class_label", F.col("score").alias("confidence"), F.struct("x1", "y1", "x2", "y2").alias("bbox"))
    messages = t.boxes.groupBy(F.col("camera_id").cast("string").alias("camera_id"), "frame_id").agg((F.first("frame_id") * 1000).alias("timestamp_ms"), F.lit(30.0).alias("fps"), F.collect_list(det).alias("detections"))
    messages.write.json(out)
    rows = _drained(t, S.detections(S.frame_stream(t.spark, out)))
    return rows.groupBy(F.col("camera_id").cast("long").alias("camera_id"), "frame_id").agg(F.count(F.lit(1)).alias("detections"), F.round(F.sum("confidence"), 4).alias("score"))


@query("S11 D1")
def live_alert_sink(t):
    """Suppressed alerts published as JSON payloads by the batch writer of the stream."""
    out = scratch_path(t.spark, "published")
    rows = _events(t).select("camera_id", F.col("event_type").alias("zone_id"), "ts", "ts_ms")
    kept = T.suppress(rows, ["camera_id", "zone_id"], 6 * HOUR).withColumn("event_type", F.lit("anomaly")).withColumn("severity", F.lit("LOW")).withColumn(
        "metadata", F.to_json(F.struct(F.col("zone_id").alias("person_name"), F.col("ts_ms").alias("moment"))))

    def write(batch, batch_id):
        A.publishable(A.with_event_id(batch)).write.mode("overwrite").json(f"{out}/data/batch={batch_id}")

    R.drained(kept.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start())
    return t.spark.read.schema("event_id string, payload string").json(f"{out}/data").select("event_id", "payload")
