"""Windows, sorts, pages and set operations."""

from pyspark.sql import functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.operators import joins as J, ranking as K, tracks as T
from vigilgrid.operators.ordered import back, islands, time_chunk, trailing_count, with_history
from vigilgrid.functions.geometry import within_polygon

DAY = 86_400_000
TRACK = ["camera_id", "track_id"]
ORDER = ["ts_ms", "point_id"]
W = "PARTITION BY camera_id, track_id ORDER BY ts_ms, point_id"


def _motion(t, steps=5):
    return T.motion(t.points, TRACK, "ts_ms", "x", "y", steps, DAY, ORDER)


@query("W1", "points", f"SELECT point_id, lag(x) OVER ({W}) AS prev_x, lag(y) OVER ({W}) AS prev_y FROM points")
def previous_centres(t):
    h = with_history(t.points, TRACK, ORDER, ["x", "y"], 2, time_chunk("ts_ms", DAY), "h")
    return h.select("point_id", back("h", 1)["x"].alias("prev_x"), back("h", 1)["y"].alias("prev_y"))


@query("W2", "points", f"SELECT point_id, round(x - lag(x, 4) OVER ({W}), 6) AS move_x, round(y - lag(y, 4) OVER ({W}), 6) AS move_y FROM points")
def motion_vectors(t):
    return _motion(t).select("point_id", F.round("move_x", 6).alias("move_x"), F.round("move_y", 6).alias("move_y"))


@query("W3", "points", f"""SELECT point_id, round(sqrt((x - 2 * x1 + x2)^2 + (y - 2 * y1 + y2)^2), 5) AS acceleration FROM (SELECT point_id, x, y,
 lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM points WINDOW w AS ({W}))""")
def accelerations(t):
    return _motion(t).select("point_id", F.round("acceleration", 5).alias("acceleration"))


@query("W4", "points", f"""SELECT point_id, n >= 3 AND sx < 40 AND sy < 25 AS is_stationary FROM (SELECT point_id, count(*) OVER w AS n, stddev_pop(x) OVER w AS sx,
 stddev_pop(y) OVER w AS sy FROM points WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""")
def stationary_points(t):
    h = T.motion(t.points.withColumn("sx", F.col("x") / 10).withColumn("sy", F.col("y") / 6.25), TRACK, "ts_ms", "sx", "sy", 5, DAY, ORDER)
    return h.select("point_id", T.stationary(F.col("path"), 4.0).alias("is_stationary"))


@query("W5", "points", f"""SELECT camera_id, track_id, round(sum(d), 4) AS path_px, round(CASE WHEN max(ts_ms) > min(ts_ms) THEN sum(d) / ((max(ts_ms) - min(ts_ms)) / 1000)
 ELSE 0 END, 8) AS px_per_s FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER ({W}))^2 + (y - lag(y) OVER ({W}))^2), 0) AS d FROM points) GROUP BY 1, 2""")
def track_speeds(t):
    h = with_history(t.points, TRACK, ORDER, ["x", "y"], 2, time_chunk("ts_ms", DAY), "h")
    p = back("h", 1)
    step = F.coalesce(F.sqrt((F.col("x") - p["x"]) ** 2 + (F.col("y") - p["y"]) ** 2), F.lit(0.0))
    span = (F.max("ts_ms") - F.min("ts_ms")) / 1000
    return h.withColumn("d", step).groupBy(*TRACK).agg(
        F.round(F.sum("d"), 4).alias("path_px"),
        F.round(F.when(span > 0, F.sum("d") / span).otherwise(0.0), 8).alias("px_per_s"))


@query("W7 G1", "detections", """SELECT segment_id, track_id, round(sqrt((lx - fx)^2 + (ly - fy)^2), 6) AS displacement, sqrt((lx - fx)^2 + (ly - fy)^2) >= 0.05 AS moving
 FROM (SELECT segment_id, track_id, count(*) AS n, first(cx ORDER BY frame_number, det_id) AS fx, first(cy ORDER BY frame_number, det_id) AS fy,
  last(cx ORDER BY frame_number, det_id) AS lx, last(cy ORDER BY frame_number, det_id) AS ly FROM (SELECT *, track_id % 3 AS t3, bbox_x + bbox_w / 2 AS cx,
  bbox_y + bbox_h / 2 AS cy FROM detections) GROUP BY segment_id, track_id) WHERE n >= 3""".replace("segment_id, track_id, count(*)", "segment_id, t3 AS track_id, count(*)").replace("GROUP BY segment_id, track_id)", "GROUP BY segment_id, t3)"))
def net_displacements(t):
    from vigilgrid.plans.search import displacement
    d = t.detections.withColumn("track_id", F.col("track_id") % 3)
    return displacement(d).select("segment_id", "track_id", F.round("displacement", 6).alias("displacement"), "moving")


@query("W8", "detections", """SELECT segment_id, t3 AS track_id, det_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, t3 ORDER BY confidence DESC, det_id) AS r
 FROM (SELECT *, track_id % 3 AS t3 FROM detections)) WHERE r = 1""")
def best_hit_per_track(t):
    d = t.detections.select("segment_id", (F.col("track_id") % 3).alias("track_id"), "det_id", "confidence").withColumn("neg", -F.col("det_id"))
    return K.latest_per_key(d, ["segment_id", "track_id"], ["confidence", "neg"]).drop("neg")


INSIDE = "x > 10 AND x < 60 AND y > 10 AND y < 80"


@query("W9", "points", f"""SELECT point_id, entered_ms, ts_ms - entered_ms AS dwell_ms FROM (SELECT *, min(ts_ms) OVER (PARTITION BY camera_id, track_id, isl) AS entered_ms FROM
 (SELECT *, sum(CASE WHEN ins AND NOT coalesce(pins, false) THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS isl FROM
 (SELECT *, lag(ins) OVER ({W}) AS pins FROM (SELECT *, {INSIDE} AS ins FROM points))) WHERE ins)""")
def zone_dwell_islands(t):
    box = [(10, 10), (60, 10), (60, 80), (10, 80)]
    out = islands(t.points, TRACK, ORDER, within_polygon(F.col("x"), F.col("y"), box), "ts_ms", time_chunk("ts_ms", DAY), "entered_ms")
    return out.where(F.col("entered_ms").isNotNull()).select("point_id", "entered_ms", (F.col("ts_ms") - F.col("entered_ms")).alias("dwell_ms"))


@query("W10", "points", f"""SELECT point_id, still_since, lone_since FROM (SELECT *, min(ts_ms) FILTER (still) OVER (PARTITION BY camera_id, track_id, i1) AS still_since,
 min(ts_ms) FILTER (lone) OVER (PARTITION BY camera_id, track_id, i2) AS lone_since FROM (SELECT *,
  sum(CASE WHEN still AND NOT coalesce(p1, false) THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS i1,
  sum(CASE WHEN lone AND NOT coalesce(p2, false) THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS i2 FROM
 (SELECT *, lag(still) OVER ({W}) AS p1, lag(lone) OVER ({W}) AS p2 FROM (SELECT *, x < 50 AS still, x < 50 AND y < 60 AS lone FROM points)))) WHERE lone""")
def nested_islands(t):
    chunk = time_chunk("ts_ms", DAY)
    one = islands(t.points, TRACK, ORDER, F.col("x") < 50, "ts_ms", chunk, "still_since")
    two = islands(one, TRACK, ORDER, F.col("still_since").isNotNull() & (F.col("y") < 60), "ts_ms", chunk, "lone_since")
    return two.where(F.col("lone_since").isNotNull()).select("point_id", "still_since", "lone_since")


@query("W11", "points", """SELECT point_id, CASE WHEN n > 1 THEN n / 2.0::DOUBLE ELSE 0::DOUBLE END AS rate FROM (SELECT point_id, count(*) OVER (PARTITION BY camera_id
 ORDER BY ts_ms RANGE BETWEEN 7199999 PRECEDING AND CURRENT ROW) AS n FROM points)""")
def rolling_rates(t):
    out = trailing_count(t.points, ["camera_id"], "ts_ms", 7_200_000, "n", DAY)
    return out.select("point_id", F.when(F.col("n") > 1, F.col("n") / 2.0).otherwise(0.0).alias("rate"))


@query("W12 E1", "", "SELECT source, 1.0::DOUBLE / min(r) AS reciprocal_rank FROM (SELECT d.*, l.quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS r "
       "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE quality = 1 GROUP BY 1")
def reciprocal_ranks(t):
    from vigilgrid.plans.evaluation import first_relevant_rank
    d = t.raw("documents").select("source", "doc_id", "n_chars")
    good = t.raw("labels").where(F.col("quality") == 1).select("doc_id").withColumn("relevant", F.lit(True))
    ranked = d.join(good, "doc_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return first_relevant_rank(ranked, ["source"], "n_chars", "doc_id").where(F.col("rank").isNotNull()).select(
        "source", (F.lit(1.0) / F.col("rank")).alias("reciprocal_rank"))


@query("W14 A24", "points", """SELECT point_id, s.state, s.life_start FROM points p JOIN rec s USING (camera_id, track_id, ts_ms) """, ctes="""o AS (SELECT camera_id, track_id, ts_ms,
 row_number() OVER (PARTITION BY camera_id, track_id ORDER BY ts_ms) AS i FROM points), rec AS (
 SELECT camera_id, track_id, ts_ms, i, 'tentative' AS state, ts_ms AS life_start FROM o WHERE i = 1 UNION ALL
 SELECT o.camera_id, o.track_id, o.ts_ms, o.i,
  CASE WHEN o.ts_ms - r.ts_ms > 86400000 THEN 'tentative' WHEN r.state = 'confirmed' THEN 'confirmed' WHEN o.ts_ms - r.ts_ms <= 21600000 THEN 'confirmed' ELSE 'tentative' END,
  CASE WHEN o.ts_ms - r.ts_ms > 86400000 THEN o.ts_ms WHEN r.state = 'tentative' AND o.ts_ms - r.ts_ms > 21600000 THEN o.ts_ms ELSE r.life_start END
 FROM rec r JOIN o ON o.camera_id = r.camera_id AND o.track_id = r.track_id AND o.i = r.i + 1)""")
def track_lifecycles(t):
    return T.lifecycle(t.points, TRACK, "ts_ms", 21_600_000, 2, 86_400_000, 5 * DAY).select("point_id", "state", "life_start")


@query("W14 T8", "points", """SELECT camera_id, track_id, CASE WHEN 1706659200000 - last_seen <= 43200000 THEN 'seen' WHEN 1706659200000 - last_seen <= 86400000 THEN 'lost_or_deleted' ELSE 'deleted' END AS standing
 FROM (SELECT camera_id, track_id, max(ts_ms) AS last_seen FROM points GROUP BY 1, 2)""")
def track_standing(t):
    s = T.lifecycle(t.points, TRACK, "ts_ms", 43_200_000, 2, 86_400_000, 5 * DAY)
    end = T.lifecycle_end(s, TRACK, "ts_ms", 1706659200000, 43_200_000, 86_400_000)
    silent = F.lit(1706659200000) - F.col("last_seen")
    return end.select(*TRACK, F.when(F.col("status").isin("tentative", "confirmed"), "seen").when(silent <= 86_400_000, "lost_or_deleted")
                      .otherwise(F.col("status")).alias("standing"))


@query("W15", "searches", """SELECT query_id, query_text FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(query_text)) ORDER BY created_at DESC, query_id DESC) AS r FROM searches
 WHERE length(trim(query_text)) >= 2) WHERE r = 1 ORDER BY created_at DESC, query_id DESC LIMIT 10""")
def recent_queries(t):
    return K.recent_queries(t.searches, "query_text", "created_at", "query_id").select("query_id", "query_text")


@query("W16", "turns", "SELECT session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM turns) WHERE r <= 3")
def last_turns(t):
    return K.last_turns(t.turns, 3).select("session_id", "turn", "role")


@query("W17", "turns", """SELECT session_id, turn, CASE WHEN contains(lower(content), 'only') OR contains(lower(content), 'show') OR contains(lower(content), 'just') OR contains(lower(content), 're')
 THEN trim(coalesce(last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
 || ' ' || content) ELSE content END AS standalone FROM turns QUALIFY role = 'user'""")
def follow_up_queries(t):
    from vigilgrid.plans.search import standalone_queries
    return standalone_queries(t.turns, ["only", "show", "just", "re"]).select("session_id", "turn", "standalone")


@query("O1", "detections", "SELECT det_id, confidence FROM detections ORDER BY confidence DESC, det_id LIMIT 25")
def most_confident(t):
    return K.top(t.detections.select("det_id", "confidence"), "confidence", "det_id", 25)


@query("O3", "alerts", "SELECT id, value FROM alerts ORDER BY value DESC, id LIMIT 40")
def over_fetched(t):
    return K.over_fetch(t.alerts.select("id", "value"), "value", "id", 10)


@query("O4 F5", "alerts", "SELECT id, value, to_base64('60'::BLOB) AS next_cursor FROM alerts ORDER BY value DESC, id LIMIT 20 OFFSET 40")
def cursor_page(t):
    return K.page_with_cursor(t.alerts.select("id", "value"), "value", "id", 20, "NDA=")


@query("O4", "alerts", "SELECT id, value, CAST(NULL AS VARCHAR) AS next_cursor FROM alerts WHERE severity = 'critical' ORDER BY value DESC, id LIMIT 1000000 OFFSET 20")
def cursor_short_page(t):
    rows = t.alerts.where(F.col("severity") == "critical").select("id", "value")
    return K.page_with_cursor(rows, "value", "id", 1_000_000, "MjA=")


@query("O5", "detections", "SELECT det_id, segment_start, timestamp_ms FROM detections WHERE gallery_id = 0 ORDER BY segment_start, timestamp_ms, det_id")
def sightings_in_order(t):
    return t.detections.where(F.col("gallery_id") == 0).select("det_id", "segment_start", "timestamp_ms").orderBy("segment_start", "timestamp_ms", "det_id")


@query("O6", "alerts", "SELECT id, value FROM alerts WHERE value >= 0.2 ORDER BY value DESC, id LIMIT 8")
def best_frames(t):
    return K.top(t.alerts.select("id", "value"), "value", "id", 8, 0.20)


@query("O7", "alerts", "SELECT event_type, id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY start_time DESC, id DESC) AS r FROM alerts) WHERE r = 1")
def newest_of_type(t):
    return K.latest_per_key(t.alerts.select("event_type", "start_time", "id"), ["event_type"], ["start_time", "id"]).select("event_type", "id")


@query("O8", "detections", "SELECT det_id FROM detections ORDER BY md5('42:' || det_id), det_id LIMIT 50")
def repeatable_sample(t):
    return K.repeatable_sample(t.detections.select("det_id"), "det_id", 50)


@query("O8")
def random_sample(t):
    return K.random_sample(t.detections.select("det_id", "class_label"), 50)


@query("U1 U2", "alerts", """SELECT id, coalesce(a.value, b.value + 1) AS score FROM (SELECT id, value FROM alerts WHERE value > 40) a
 FULL JOIN (SELECT id, value FROM alerts WHERE k < 30) b USING (id) ORDER BY 2 DESC, 1 LIMIT 60""")
def federated_hits(t):
    one = t.alerts.where(F.col("value") > 40).select("id", F.col("value").alias("score"), "event_type")
    two = t.alerts.where(F.col("k") < 30).select("id", (F.col("value") + 1).alias("score"))
    return K.top(J.first_source_wins([one, two], "id"), "score", "id", 60).select("id", "score")


@query("U1", "alerts", """SELECT id, 'metadata' AS search_source FROM alerts WHERE value > 300 UNION ALL
 (SELECT id, 'semantic' FROM (SELECT id, value, k FROM alerts WHERE k < 5 ORDER BY value DESC, id LIMIT 2 * (100 - (SELECT count(*) FROM alerts WHERE value > 300)))
  WHERE id NOT IN (SELECT id FROM alerts WHERE value > 300))""")
def topped_up_hits(t):
    strict = t.alerts.where(F.col("value") > 300).select("id", F.col("value").alias("score"))
    loose = t.alerts.where(F.col("k") < 5).select("id", F.col("value").alias("score"))
    return J.top_up(strict, loose, "id", 100, "score").select("id", "search_source")


@query("U3", "cameras", "SELECT camera_id FROM cameras WHERE org_id = 1 INTERSECT SELECT camera_id FROM cameras WHERE status = 'active'")
def permitted_cameras(t):
    return t.cameras.where(F.col("org_id") == 1).select("camera_id").intersect(t.cameras.where(F.col("status") == "active").select("camera_id"))


@query("U3", "cameras alerts", "SELECT id FROM alerts WHERE false")
def permitted_nothing(t):
    ok = t.cameras.where(F.col("org_id") == 1).select("camera_id").intersect(t.cameras.where(F.col("org_id") == 2).select("camera_id"))
    return t.alerts.join(ok, "camera_id", "left_semi").select("id")


@query("U4 U5 F11", "alerts", """SELECT id, array_to_string(list_sort(list_filter(['a','b','c'], lambda x: x <> CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END)), ',') AS kept,
 array_to_string(list_sort(list_distinct(list_concat(['a'], ['a', event_type]))), ',') AS merged FROM alerts""")
def class_list_algebra(t):
    k = F.col("k") % 3
    drop = F.array(F.when(k == 0, "a").when(k == 1, "b").otherwise("c"))
    abc = F.array(*[F.lit(c) for c in "abc"])
    return t.alerts.select("id", F.array_join(F.array_sort(F.array_except(abc, drop)), ",").alias("kept"),
                           F.array_join(F.array_sort(F.array_union(F.array(F.lit("a")), F.array(F.lit("a"), F.col("event_type")))), ",").alias("merged"))
