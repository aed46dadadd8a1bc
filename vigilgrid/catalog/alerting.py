"""Alert rules, suppression and health."""

from pyspark.sql import functions as F

from vigilgrid.catalog.joining import meets_sql, ring_sql
from vigilgrid.catalog.registry import query
from vigilgrid.plans import alerts as A
from vigilgrid.sources.standin import AS_OF_MS

HOUR, DAY = 3_600_000, 86_400_000
ZONES = {"yard": [(5.0, 5.0), (60.0, 5.0), (60.0, 95.0), (5.0, 95.0)], "gate": [(0.0, 60.0), (40.0, 100.0), (80.0, 60.0), (40.0, 80.0)]}
LINES = {"fence": [(30.0, 0.0), (30.0, 100.0)]}
BASE = {"chunk_ms": 5 * DAY}


def tracks(t):
    """Points as tracks of 10 px boxes."""
    p = t.points
    return p.select("camera_id", "track_id", F.col("class_id").cast("int").alias("class_id"), "ts_ms", (F.col("x") - 5).alias("x1"), (F.col("y") - 5).alias("y1"),
                    (F.col("x") + 5).alias("x2"), (F.col("y") + 5).alias("y2"))


def frames(t):
    """Mean position per track and hour, so that tracks of a camera share moments; 40 px boxes."""
    h = t.points.groupBy("camera_id", "track_id", F.col("class_id").cast("int").alias("class_id"), (F.floor(F.col("ts_ms") / (6 * HOUR)) * (6 * HOUR)).cast("long").alias("ts_ms")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"))
    return h.select("camera_id", "track_id", "class_id", "ts_ms", (F.col("x") - 20).alias("x1"), (F.col("y") - 20).alias("y1"), (F.col("x") + 20).alias("x2"), (F.col("y") + 20).alias("y2"))


def suppressed_sql(candidates, gap):
    """Keep a row when it lies more than ``gap`` after the last kept one of camera and zone."""
    return f"""{candidates}, so AS (SELECT camera_id, zone_id, ts_ms, row_number() OVER (PARTITION BY camera_id, zone_id ORDER BY ts_ms) AS i FROM (SELECT DISTINCT camera_id, zone_id, ts_ms FROM cand)),
 sr AS (SELECT camera_id, zone_id, i, ts_ms, ts_ms AS last, true AS kept FROM so WHERE i = 1 UNION ALL SELECT so.camera_id, so.zone_id, so.i, so.ts_ms, CASE WHEN so.ts_ms - sr.last > {gap} THEN so.ts_ms ELSE sr.last END,
 so.ts_ms - sr.last > {gap} FROM sr JOIN so ON so.camera_id = sr.camera_id AND so.zone_id = sr.zone_id AND so.i = sr.i + 1)"""


KEPT = "SELECT camera_id, zone_id, ts_ms FROM sr WHERE kept"


def _shown(alerts):
    return alerts.select("camera_id", F.coalesce("zone_id", F.lit("")).alias("zone_id"), "ts_ms")


@query("T1 W9", "alerts", KEPT, suppressed_sql("cand AS (SELECT camera_id, event_type AS zone_id, start_ms AS ts_ms FROM alerts)", 6 * HOUR))
def suppressed_alerts(t):
    c = t.alerts.select("camera_id", F.lit("x").alias("event_type"), F.col("event_type").alias("zone_id"), F.col("start_ms").alias("ts_ms"), F.col("id").alias("order"))
    return _shown(A.suppress(c, 6 * HOUR, chunk_ms=2 * DAY))


W = "PARTITION BY camera_id, track_id, zone_id ORDER BY ts_ms"
LOITER = "zi AS (" + " UNION ALL ".join(f"SELECT camera_id, track_id, ts_ms, '{z}' AS zone_id, {ring_sql('x', 'y', r)} AS ins FROM points" for z, r in ZONES.items()) + f"""),
 zs AS (SELECT *, sum(CASE WHEN ins AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, lag(ins) OVER ({W}) AS p FROM zi)),
 cand AS (SELECT * FROM (SELECT *, ts_ms - min(ts_ms) OVER (PARTITION BY camera_id, track_id, zone_id, isl) AS dwell FROM zs WHERE ins) WHERE dwell >= {12 * HOUR})"""


@query("T2 R1", "points", KEPT, suppressed_sql(LOITER, 6 * HOUR))
def loitering_alerts(t):
    c = A.loitering(tracks(t), {**BASE, "dwell_threshold_ms": 12 * HOUR, "zones": ZONES})
    return _shown(A.suppress(c, 6 * HOUR, chunk_ms=2 * DAY))


STEP = "st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM points WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_ms))"


@query("T3 R1", "points", KEPT, suppressed_sql(STEP + ", cand AS (SELECT camera_id, 'fence' AS zone_id, ts_ms FROM st WHERE px IS NOT NULL AND " + meets_sql(("px", "py"), ("x", "y"), (30.0, 0.0), (30.0, 100.0))
       + " UNION ALL " + " UNION ALL ".join(f"SELECT camera_id, '{z}', ts_ms FROM st WHERE px IS NOT NULL AND NOT {ring_sql('px', 'py', r)} AND {ring_sql('x', 'y', r)}" for z, r in ZONES.items()) + ")", 6 * HOUR))
def perimeter_alerts(t):
    return _shown(A.suppress(A.perimeter(tracks(t), {**BASE, "lines": LINES, "zones": ZONES}), 6 * HOUR, chunk_ms=2 * DAY))


@query("T4 R1 W2", "points", KEPT, suppressed_sql("""mv AS (SELECT *, x - lag(x, 4) OVER w AS mx, y - lag(y, 4) OVER w AS my FROM points WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_ms)),
 cand AS (SELECT camera_id, '' AS zone_id, ts_ms FROM mv WHERE mx IS NOT NULL AND sqrt(mx^2 + my^2) >= 10 AND mx / sqrt(mx^2 + my^2) < cos(radians(90)))""", 6 * HOUR))
def wrong_direction_alerts(t):
    return _shown(A.suppress(A.wrong_direction(tracks(t), BASE), 6 * HOUR, chunk_ms=2 * DAY))


FR = f"""fr AS (SELECT camera_id, track_id, CAST(class_id AS INT) AS cls, (ts_ms // {6 * HOUR}) * {6 * HOUR} AS ts_ms, avg(x) AS x, avg(y) AS y FROM points GROUP BY ALL)"""
CROWD = FR + """, pe AS (SELECT *, row_number() OVER () AS n FROM fr WHERE cls = 0), ed AS (SELECT a.n AS a, b.n AS b FROM pe a JOIN pe b ON a.camera_id = b.camera_id AND a.ts_ms = b.ts_ms WHERE sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 15),
 rc AS (SELECT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b), gr AS (SELECT a AS n, min(b) AS g FROM rc GROUP BY 1),
 cand AS (SELECT camera_id, '' AS zone_id, ts_ms FROM pe JOIN gr USING (n) GROUP BY camera_id, ts_ms, g HAVING count(*) >= 3)"""


@query("T5 G10 A26 A27", "points", KEPT, suppressed_sql(CROWD, 12 * HOUR))
def crowd_alerts(t):
    return _shown(A.crowd(frames(t), {**BASE, "density_threshold": 15.0, "count_threshold": 3}, 640, 480, 12 * HOUR))


ABANDON = FR + f""", bg AS (SELECT *, n >= 3 AND sx < 60 AND sy < 30 AS still FROM (SELECT *, count(*) OVER w AS n, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM fr WHERE cls = 26
  WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))),
 al AS (SELECT *, still AND NOT EXISTS (SELECT 1 FROM fr p WHERE p.cls = 0 AND p.camera_id = bg.camera_id AND p.ts_ms = bg.ts_ms AND sqrt((p.x - bg.x)^2 + (p.y - bg.y)^2) <= 25) AS alone FROM bg),
 ai AS (SELECT *, sum(CASE WHEN alone AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, track_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, lag(alone) OVER (PARTITION BY camera_id, track_id ORDER BY ts_ms) AS p FROM al)),
 cand AS (SELECT camera_id, '' AS zone_id, ts_ms FROM (SELECT *, ts_ms - min(ts_ms) OVER (PARTITION BY camera_id, track_id, isl) AS span FROM ai WHERE alone) WHERE span >= {6 * HOUR})"""


@query("T6 W4 W10 J14", "points", KEPT, suppressed_sql(ABANDON.replace("sx < 60 AND sy < 30", "sx < 40 AND sy < 40"), 12 * HOUR))
def abandoned_alerts(t):
    rules = {**BASE, "proximity_threshold": 25.0, "stationary_std_threshold": 40.0, "abandoned_time_threshold_ms": 6 * HOUR}
    return _shown(A.suppress(A.abandoned(frames(t), rules), 12 * HOUR, chunk_ms=2 * DAY))


FIGHT = FR + """, ac AS (SELECT *, sqrt((x - 2 * x1 + x2)^2 + (y - 2 * y1 + y2)^2) AS acc FROM (SELECT *, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM fr WHERE cls = 0
 WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_ms))), cand AS (SELECT a.camera_id, '' AS zone_id, a.ts_ms FROM ac a JOIN ac b ON a.camera_id = b.camera_id AND a.ts_ms = b.ts_ms AND a.track_id < b.track_id
 WHERE a.acc > 30 AND b.acc > 30 AND greatest(0, 40 - abs(a.x - b.x)) * greatest(0, 40 - abs(a.y - b.y)) / 1600 >= 0.35)"""


@query("T7 J16 W3", "points", KEPT, suppressed_sql(FIGHT, 12 * HOUR))
def fight_alerts(t):
    return _shown(A.suppress(A.fight(frames(t), BASE, every=False), 12 * HOUR, chunk_ms=2 * DAY))


@query("R1 T1 D1 S11")
def published_alerts(t):
    found = A.detect(tracks(t), {"loitering": {**BASE, "zones": ZONES, "dwell_threshold_ms": 12 * HOUR}, "wrong_direction": BASE}, 2 * HOUR)
    return A.publishable(found)


@query("T9 A24", "points", f"""SELECT camera_id, track_id, round((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE, 3) AS dwell_s, (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE > CASE class_id WHEN '0' THEN 2500000 WHEN '2' THEN 2560000 ELSE 2550000 END AS is_suspicious
 FROM points GROUP BY camera_id, track_id, class_id""")
def suspicious_dwells(t):
    p = t.points.withColumn("class_label", F.when(F.col("class_id") == "0", "person").when(F.col("class_id") == "2", "car").otherwise("backpack"))
    out = A.suspicious_dwell(p, limits={"person": 2_500_000.0, "vehicle": 2_560_000.0, "object": 2_550_000.0})
    return out.select("camera_id", "track_id", F.round("dwell_s", 3).alias("dwell_s"), "is_suspicious")


@query("A24", "points", "SELECT camera_id, track_id, count(*) AS hits, round(avg(x), 6) AS avg_confidence, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen FROM points GROUP BY 1, 2")
def track_summaries(t):
    from vigilgrid.operators.tracks import track_summary
    return track_summary(t.points, ["camera_id", "track_id"], "ts_ms", "x").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("T10 W11", "points", f"""SELECT track_id AS camera_id, CASE WHEN {AS_OF_MS} - ts_ms > {18 * HOUR} THEN 'offline' WHEN y >= 90 THEN 'critical' WHEN y >= 50 THEN 'degraded' WHEN x > 0 AND x / 100 < 0.3 THEN 'critical' WHEN x > 0 AND x / 100 < 0.7 THEN 'degraded' ELSE 'healthy' END AS status
 FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts_ms DESC) AS r FROM points) WHERE r = 1""")
def camera_statuses(t):
    p = t.points.select(F.col("track_id").alias("camera_id"), "ts_ms", F.col("x").alias("fps"), F.lit(100.0).alias("target_fps"),
                        F.when(F.col("y") >= 90, 20).when(F.col("y") >= 50, 5).otherwise(0).alias("errors"))
    return A.camera_status(p, AS_OF_MS, stale_ms=18 * HOUR).select("camera_id", "status")


@query("T11", "points", """SELECT camera_id, make_timestamp(w * 1000) AS start_time, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS frames, round(CASE WHEN max(ts_ms) > min(ts_ms) THEN (count(*) - 1) / ((max(ts_ms) - min(ts_ms)) / 1000) END, 8) AS fps
 FROM (SELECT camera_id, ts_ms, unnest(range((ts_ms // 25200000) * 25200000 - 25200000, ts_ms + 1, 25200000)) AS w FROM points) WHERE w <= ts_ms AND ts_ms < w + 28800000 GROUP BY 1, 2 HAVING count(*) >= 2""")
def frame_segments(t):
    from vigilgrid.plans.ingest import segments
    p = t.points.withColumn("ts", F.timestamp_millis("ts_ms"))
    out = segments(p, "ts", 8 * 3600, 3600)
    return out.select("camera_id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "first_ms", "last_ms", "frames", F.round("fps", 8).alias("fps"))


@query("T13", "alerts", "SELECT user_id, win AS opened_ms, count(*) AS requests, greatest(count(*) - 3, 0) AS refused FROM r GROUP BY 1, 2", f"""o AS (SELECT user_id, start_ms AS ts, row_number() OVER (PARTITION BY user_id ORDER BY start_ms) AS i FROM alerts),
 r AS (SELECT user_id, i, ts, ts AS win FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.ts, CASE WHEN o.ts - r.win >= {DAY} THEN o.ts ELSE r.win END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)""")
def rate_limits(t):
    from vigilgrid.plans.ingest import rate_windows
    return rate_windows(t.alerts, ["user_id"], "start_ms", 3, DAY, 5 * DAY)


LOCKS = f"""o AS (SELECT user_id, start_ms AS ts, row_number() OVER (PARTITION BY user_id ORDER BY start_ms) AS i FROM alerts),
 r AS (SELECT user_id, i, ts, ts AS win, 1 AS n, CAST(0 AS BIGINT) AS until, false AS locks FROM o WHERE i = 1 UNION ALL
 SELECT o.user_id, o.i, o.ts, CASE WHEN ign THEN r.win WHEN fresh THEN o.ts ELSE r.win END, CASE WHEN ign THEN r.n WHEN fresh THEN 1 WHEN r.n + 1 >= 5 THEN 0 ELSE r.n + 1 END,
  CASE WHEN NOT ign AND NOT fresh AND r.n + 1 >= 5 THEN o.ts + {2 * DAY} ELSE r.until END, NOT ign AND NOT fresh AND r.n + 1 >= 5
 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT o.ts < r.until AS ign, r.n = 0 OR o.ts - r.win >= {3 * DAY} AS fresh))"""


@query("T14", "alerts", "SELECT user_id, ts AS locked_ms FROM r WHERE locks", LOCKS)
def lockouts(t):
    from vigilgrid.plans.ingest import lockouts as find
    return find(t.alerts, ["user_id"], "start_ms", 5, 3 * DAY, 2 * DAY, 6 * DAY).select("user_id", "locked_ms")
