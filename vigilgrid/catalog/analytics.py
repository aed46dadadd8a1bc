"""Rollups, KPIs and dashboard reports."""

from pyspark.sql import functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.operators import rollups as R
from vigilgrid.plans import reports as P
from vigilgrid.sources.standin import AS_OF

ORG = 2
SINCE = {d: f"TIMESTAMP '{AS_OF}' - INTERVAL {d}" for d in ("1 HOUR", "1 MINUTE", "1 DAY", "30 DAYS", "90 DAYS")}
HOURLY = ("eh AS (SELECT date_trunc('hour', start_time) AS bucket, org_id, camera_id, event_type, severity, "
          "count(*) AS event_count FROM alerts GROUP BY ALL)")
SEARCHES = ("sh AS (SELECT date_trunc('hour', created_at) AS bucket, org_id, count(*) AS query_count, "
            "avg(latency_ms) AS avg_latency_ms, count(*) FILTER (results_count = 0) AS zero_results_count "
            "FROM searches GROUP BY ALL)")
HEALTH = ("hh AS (SELECT date_trunc('hour', ts) AS bucket, org_id, camera_id, "
          "avg(CASE WHEN uptime_status = 'online' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS uptime_ratio, "
          "avg(frame_drop_rate) AS avg_frame_drop_rate, avg(detection_latency_ms) AS avg_detection_latency_ms "
          "FROM health GROUP BY ALL)")
ZONE = ("CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(name), '{w.lower()}') OR contains(lower(location), '{w.lower()}')"
                          for w in words) + f" THEN '{z}'" for z, words in P.ZONE_WORDS.items()) + " ELSE 'lobby' END")


def _hourly(t, **last):
    """Hourly events, of the time before ``AS_OF`` that a report looks at or of all time."""
    return R.events_hourly(P.recent(t.alerts, "start_time", AS_OF, **last) if last else t.alerts)


@query("A1 F7", "alerts", "SELECT * FROM eh", HOURLY)
def events_hourly(t):
    return _hourly(t)


@query("A2", "searches", "SELECT bucket, org_id, query_count, round(avg_latency_ms, 6) AS avg_latency_ms, "
       "zero_results_count FROM sh", SEARCHES)
def searches_hourly(t):
    return R.searches_hourly(t.searches).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("A3", "detections", "SELECT date_trunc('day', created_at) AS bucket, org_id, class_label, "
       "count(*) AS object_count FROM detections GROUP BY ALL")
def detections_daily(t):
    return R.detections_daily(t.detections)


@query("A4", "health", "SELECT bucket, org_id, camera_id, round(uptime_ratio, 6) AS uptime_ratio, "
       "round(avg_frame_drop_rate, 6) AS avg_frame_drop_rate, round(avg_detection_latency_ms, 6) "
       "AS avg_detection_latency_ms FROM hh", HEALTH)
def camera_health_hourly(t):
    h = R.health_hourly(t.health)
    return h.select("bucket", "org_id", "camera_id", *[
        F.round(c, 6).alias(c) for c in ("uptime_ratio", "avg_frame_drop_rate", "avg_detection_latency_ms")])


KPI_SQL = f"""
SELECT (SELECT count(*) FROM cameras WHERE org_id = {ORG} AND NOT is_deleted) AS total_cameras,
 (SELECT count(*) FROM cameras WHERE org_id = {ORG} AND NOT is_deleted AND status = 'active') AS active_cameras,
 (SELECT CAST(coalesce(sum(event_count), 0) AS BIGINT) FROM eh WHERE org_id = {ORG} AND bucket >= {SINCE['1 HOUR']}) AS events_per_hour,
 (SELECT count(*) FROM searches WHERE org_id = {ORG} AND created_at >= {SINCE['1 MINUTE']}) AS queries_per_minute,
 (SELECT round(avg(avg_latency_ms), 1) FROM sh WHERE org_id = {ORG} AND bucket >= {SINCE['1 DAY']}) AS average_search_latency_ms"""


@query("A5 A6 A7 A8", "alerts cameras searches", KPI_SQL, f"{HOURLY}, {SEARCHES}")
def realtime_kpis(t):
    return P.realtime_kpis(t.cameras, _hourly(t, hours=1), t.searches, ORG, AS_OF)


@query("A8", "searches", f"SELECT round(avg(avg_latency_ms), 4) AS mean_of_hours, round(sum(avg_latency_ms * "
       f"query_count) / sum(query_count), 4) AS mean_of_queries FROM sh WHERE org_id = {ORG} AND bucket >= {SINCE['30 DAYS']}", SEARCHES)
def search_latency_weighted(t):
    return P.latency_weighted(P.recent(t.searches, "created_at", AS_OF, days=30), ORG, AS_OF)


HEATMAP = f"""placed AS (SELECT camera_id, {ZONE} AS zone FROM cameras WHERE org_id = {ORG}),
counted AS (SELECT hour(bucket) AS hour, zone, sum(event_count) AS n FROM eh JOIN placed USING (camera_id)
 WHERE org_id = {ORG} AND bucket >= {SINCE['1 DAY']} GROUP BY ALL),
heat AS (SELECT h.range AS hour, """ + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (zone = '{z}'), 0) AS BIGINT) AS {z}" for z in P.ZONE_WORDS) + """
 FROM range(24) h LEFT JOIN counted c ON c.hour = h.range GROUP BY h.range)"""


@query("A9 J5", "alerts cameras", "SELECT * FROM heat", f"{HOURLY}, {HEATMAP}")
def traffic_heatmap(t):
    return P.traffic_heatmap(_hourly(t, days=1), t.cameras, ORG, AS_OF)


@query("A28", "alerts cameras", """SELECT hour, zone, value, round(value / top, 6) AS ratio,
 CAST(CASE WHEN value = 0 THEN 0 WHEN value / top < 0.2 THEN 1 WHEN value / top < 0.4 THEN 2
 WHEN value / top < 0.6 THEN 3 WHEN value / top < 0.8 THEN 4 ELSE 5 END AS BIGINT) AS band
 FROM long, (SELECT greatest(max(value), 1)::DOUBLE AS top FROM long)""",
       f"{HOURLY}, {HEATMAP}, long AS (UNPIVOT heat ON {', '.join(P.ZONE_WORDS)} INTO NAME zone VALUE value)")
def heatmap_bands(t):
    return P.heatmap_bands(P.traffic_heatmap(_hourly(t, days=1), t.cameras, ORG, AS_OF))


@query("J5", "cameras", f"SELECT camera_id, {ZONE} AS zone FROM cameras")
def camera_zones(t):
    return t.cameras.select("camera_id", P.zone_of_camera(F.col("name"), F.col("location")).alias("zone"))


@query("A10", "detections", f"""SELECT strftime(created_at, '%Y-%m-%d') AS date,
 count(*) FILTER (class_label IN ('person','people')) AS people,
 count(*) FILTER (class_label IN ('vehicle','car','suv','truck')) AS vehicles
 FROM detections WHERE org_id = {ORG} AND date_trunc('day', created_at) >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAYS GROUP BY 1""")
def object_trends(t):
    return P.object_trends(R.detections_daily(P.recent(t.detections, "created_at", "2001-06-01 00:00:00", days=90)), ORG, "2001-06-01 00:00:00")


@query("A11", "alerts", f"SELECT event_type AS name, CAST(sum(event_count) AS BIGINT) AS value FROM eh WHERE org_id = {ORG} GROUP BY 1", HOURLY)
def event_distribution(t):
    return P.event_distribution(_hourly(t), ORG)


@query("A12", "alerts", f"SELECT severity, CAST(sum(event_count) AS BIGINT) AS total FROM eh WHERE org_id = {ORG} GROUP BY 1", HOURLY)
def severity_totals(t):
    return P.severity_totals(_hourly(t), ORG)


@query("A13 F7", "alerts", f"SELECT printf('%02d:00', hour(bucket)) AS hour, CAST(sum(event_count) AS BIGINT) AS events "
       f"FROM eh WHERE org_id = {ORG} AND bucket >= {SINCE['30 DAYS']} GROUP BY 1", HOURLY)
def peak_hours(t):
    return P.peak_hours(_hourly(t, days=30), ORG, AS_OF)


HEALTH_REPORT = f"""rep AS (SELECT c.camera_id, name, location, status, uptime_percent, frame_drop_rate, latency_ms
 FROM cameras c LEFT JOIN (SELECT camera_id, round(avg(uptime_ratio) * 100, 2) AS uptime_percent,
  round(avg(avg_frame_drop_rate), 2) AS frame_drop_rate, CAST(trunc(avg(avg_detection_latency_ms)) AS BIGINT) AS latency_ms
  FROM hh WHERE org_id = {ORG} AND bucket >= {SINCE['1 DAY']} GROUP BY 1) h ON h.camera_id = c.camera_id
 WHERE org_id = {ORG} AND NOT is_deleted)"""


@query("A14 J4", "health cameras", "SELECT * FROM rep", f"{HEALTH}, {HEALTH_REPORT}")
def camera_health(t):
    return P.camera_health(R.health_hourly(P.recent(t.health, "ts", AS_OF, days=1)), t.cameras, ORG, AS_OF)


@query("P20", "health cameras", "SELECT * FROM rep WHERE status <> 'active' OR frame_drop_rate > 5 OR uptime_percent < 98",
       f"{HEALTH}, {HEALTH_REPORT}")
def troubled_cameras(t):
    return P.troubled_cameras(P.camera_health(R.health_hourly(P.recent(t.health, "ts", AS_OF, days=1)), t.cameras, ORG, AS_OF))


@query("A15 O9", "searches", f"SELECT query_text AS query, count(*) AS count FROM searches WHERE org_id = {ORG} AND "
       f"created_at >= {SINCE['30 DAYS']} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_queries(t):
    return P.top_queries(t.searches, ORG, AS_OF)


@query("A16", "searches", f"SELECT round(avg(avg_latency_ms), 1) AS average_latency_ms, "
       f"round(coalesce(sum(zero_results_count) / nullif(sum(query_count), 0) * 100, 0), 2) AS zero_result_rate_percent "
       f"FROM sh WHERE org_id = {ORG} AND bucket >= {SINCE['30 DAYS']}", SEARCHES)
def search_quality(t):
    return P.search_quality(R.searches_hourly(P.recent(t.searches, "created_at", AS_OF, days=30)), ORG, AS_OF)


NOISE = f"""noise AS (SELECT strftime(start_time, '%Y-%m-%d') AS date, count(*) AS total_alerts,
 count(*) FILTER (k < 20) AS false_positives FROM alerts WHERE org_id = {ORG} AND start_time >= {SINCE['30 DAYS']} GROUP BY 1)"""


def _noise(t):
    return P.alert_noise_daily(t.alerts, ORG, AS_OF, F.get_json_object("metadata", "$.k").cast("long") < 20)


@query("A17 F12", "alerts", "SELECT date, total_alerts, false_positives, total_alerts - false_positives AS true_positives, "
       "round(false_positives / total_alerts * 100, 1) AS noise_ratio_percent FROM noise", NOISE)
def alert_noise_daily(t):
    return _noise(t)


@query("A17", "alerts", "SELECT round(i, 1) AS average_noise_ratio_percent, CASE WHEN i < 15 THEN 'low' WHEN i < 30 THEN "
       "'moderate' ELSE 'critical' END AS alert_fatigue_status FROM (SELECT sum(false_positives) / sum(total_alerts) * 100 AS i FROM noise)", NOISE)
def alert_fatigue(t):
    return P.alert_fatigue(_noise(t))


@query("A21", "detections", "SELECT class_label, count(*) AS detections, round(avg(confidence), 6) AS mean_confidence FROM detections GROUP BY 1")
def detections_per_class(t):
    return t.detections.groupBy("class_label").agg(F.count(F.lit(1)).alias("detections"),
                                                   F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("A22", "detections", "SELECT DISTINCT gallery_id FROM detections WHERE gallery_id IS NOT NULL")
def identities_seen(t):
    return t.detections.where(F.col("gallery_id").isNotNull()).select("gallery_id").distinct()


@query("A23", "health", "SELECT camera_id, count(*) AS n, round(avg(detection_latency_ms), 6) AS mean_ms, "
       "round(quantile_cont(detection_latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(detection_latency_ms, 0.95), 6) AS p95_ms, "
       "round(quantile_cont(detection_latency_ms, 0.99), 6) AS p99_ms, round(count(*) / sum(detection_latency_ms) * 1000, 6) AS per_second "
       "FROM health GROUP BY 1")
def latency_profile(t):
    return P.latency_profile(t.health, "detection_latency_ms", ["camera_id"])


@query("A29", "alerts", "SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "warning", "info")) + " FROM alerts")
def alerts_by_severity(t):
    return t.alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "warning", "info")])


@query("A29", "cameras", "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("active", "offline", "maintenance", "error")) + " FROM cameras")
def cameras_by_status(t):
    return t.cameras.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "offline", "maintenance", "error")])


@query("A31", "detections", "SELECT count(*) FILTER (class_label = 'person') AS persons, count(*) FILTER (class_label <> 'person') AS vehicles "
       "FROM (SELECT DISTINCT gallery_id, class_label FROM detections)")
def identities_by_type(t):
    kinds = t.detections.select("gallery_id", "class_label").distinct()
    return kinds.agg(F.count_if(F.col("class_label") == "person").alias("persons"),
                     F.count_if(F.col("class_label") != "person").alias("vehicles"))
