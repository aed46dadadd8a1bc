"""Joins of every kind the inventory lists, except those inside alert rules."""

from pyspark.sql import functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.functions import geometry as G
from vigilgrid.operators import joins as J, spatial as S, tracks as T
from vigilgrid.operators.ordered import with_history, back, time_chunk

B = "struct_pack(x1 := {0}x1, y1 := {0}y1, x2 := {0}x2, y2 := {0}y2)"
INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
IOU = f"({INTER}) / greatest(1e-6, {AREA.format('a')} + {AREA.format('b')} - ({INTER}))"


def boxed(t):
    return t.boxes.withColumn("box", G.box("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")


@query("J1", "detections segments", "SELECT d.det_id, coalesce(CASE WHEN d.track_id % 2 = 0 THEN d.track_id END, s.camera_id) AS camera_id "
       "FROM detections d LEFT JOIN segments s USING (segment_id)")
def hits_with_camera(t):
    hits = t.detections.select("det_id", "segment_id", F.when(F.col("track_id") % 2 == 0, F.col("track_id")).alias("camera_id"))
    return J.attach_camera(hits, t.segments).select("det_id", "camera_id")


@query("J2", "detections segments cameras", """SELECT det_id FROM detections WHERE segment_id IN (SELECT segment_id FROM segments WHERE camera_id IN
 (SELECT camera_id FROM cameras WHERE org_id = 1))""")
def detections_on_allowed(t):
    return J.on_allowed_cameras(t.detections, t.segments, t.cameras.where(F.col("org_id") == 1)).select("det_id")


@query("J3", "detections segments", "SELECT d.gallery_id, s.camera_id, count(*) AS sightings FROM detections d JOIN segments s USING (segment_id) GROUP BY ALL")
def sightings_by_camera(t):
    return t.detections.join(t.segments.select("segment_id", "camera_id"), "segment_id").groupBy("gallery_id", "camera_id").agg(
        F.count(F.lit(1)).alias("sightings"))


USERS = ("users AS (SELECT c_custkey AS user_id, c_custkey % 5 AS org_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'super_admin' "
         "WHEN 'MACHINERY' THEN 'operator' WHEN 'FURNITURE' THEN 'org_admin' WHEN 'HOUSEHOLD' THEN 'analyst' ELSE 'viewer' END AS role FROM customer)")


def _users(t):
    seg = F.col("c_mktsegment")
    return t.raw("customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5).alias("org_id"),
        F.when(seg == "BUILDING", "super_admin").when(seg == "MACHINERY", "operator").when(seg == "FURNITURE", "org_admin")
        .when(seg == "HOUSEHOLD", "analyst").otherwise("viewer").alias("role"))


@query("J9", "cameras", """SELECT user_id, CASE role WHEN 'super_admin' THEN 'all' ELSE 'org' END AS scope,
 CASE WHEN role <> 'super_admin' THEN org_id END AS org_id, CAST(NULL AS BIGINT) AS camera_id FROM users WHERE role <> 'operator'
 UNION ALL SELECT DISTINCT u.user_id, 'camera', u.org_id, c.camera_id FROM users u JOIN orders o ON o.o_custkey = u.user_id
 JOIN cameras c ON c.camera_id = o.o_orderkey % 100 AND c.org_id = u.org_id WHERE u.role = 'operator'""", USERS)
def camera_scopes(t):
    assigned = t.raw("orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 100).alias("camera_id"))
    return J.camera_scopes(_users(t), t.cameras, assigned)


@query("J9 J2", "detections segments cameras", """SELECT count(*) AS detections FROM detections JOIN segments USING (segment_id) WHERE camera_id IN
 (SELECT camera_id FROM cameras WHERE org_id = 2 AND camera_id IN (SELECT o_orderkey % 100 FROM orders WHERE o_custkey = 17))""")
def operator_detections(t):
    assigned = t.raw("orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 100).alias("camera_id"))
    ok = J.allowed_cameras(t.cameras, assigned, 17, 2, "operator")
    return J.on_allowed_cameras(t.detections, t.segments, ok).agg(F.count(F.lit(1)).alias("detections"))


@query("J10", "", """SELECT DISTINCT u.user_id, n.n_name AS permission FROM users u JOIN orders o ON o.o_custkey = u.user_id
 JOIN supplier s ON s.s_suppkey = o.o_orderkey % 20 JOIN nation n ON n.n_nationkey = s.s_nationkey""", USERS)
def effective_permissions(t):
    user_roles = t.raw("orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 20).alias("role_id"))
    grants = t.raw("supplier").select(F.col("s_suppkey").alias("role_id"), F.col("s_nationkey").alias("permission_id"))
    names = t.raw("nation").select(F.col("n_nationkey").alias("permission_id"), F.col("n_name").alias("permission"))
    return J.effective_permissions(_users(t), user_roles, grants, names)


@query("J10", "", "SELECT role, permission, count(*) AS users FROM users JOIN (VALUES " + ", ".join(
    f"('{r}', '{p}')" for r, ps in J.ROLE_GRANTS.items() for p in ps) + ") g(r, permission) ON r = role GROUP BY ALL", USERS)
def role_grants(t):
    return J.role_grants(_users(t), "role").groupBy("role", "permission").agg(F.count(F.lit(1)).alias("users"))


STEPS = ("st AS (SELECT camera_id, frame_id, lag(frame_id) OVER (PARTITION BY camera_id ORDER BY frame_id) AS prev FROM "
         "(SELECT DISTINCT camera_id, frame_id FROM {src}))")


def _mutual(score, cost):
    return f"""pr AS (SELECT b.camera_id, b.frame_id, a.det_id AS prev_id, b.det_id AS id, {score} AS s FROM st
  JOIN cur b ON b.camera_id = st.camera_id AND b.frame_id = st.frame_id JOIN old a ON a.camera_id = st.camera_id AND a.frame_id = st.prev
  WHERE 1 - {score} <= {cost}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY prev_id ORDER BY s DESC, id) AS r1, row_number() OVER (PARTITION BY id ORDER BY s DESC, prev_id) AS r2 FROM pr)"""


BOX_D = "SELECT det_id, camera_id, frame_id, score, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM boxes"


@query("J11 G2", "boxes", "SELECT camera_id, frame_id, prev_id, id, round(s, 6) AS iou FROM rk WHERE r1 = 1 AND r2 = 1",
       STEPS.format(src="boxes") + f", cur AS ({BOX_D}), old AS (SELECT * FROM cur), " + _mutual(IOU, 0.8))
def linked_by_overlap(t):
    return T.associate_by_overlap(boxed(t), "camera_id", "frame_id", "det_id", "box").withColumn("iou", F.round("iou", 6))


@query("J11", "boxes", """SELECT camera_id, frame_id, prev_id, id, round(s, 6) AS iou, 'high' AS stage FROM hi
 UNION ALL SELECT camera_id, frame_id, prev_id, id, round(s, 6), 'low' FROM
 (SELECT *, row_number() OVER (PARTITION BY prev_id ORDER BY s DESC, id) AS r1, row_number() OVER (PARTITION BY id ORDER BY s DESC, prev_id) AS r2 FROM lowp)
 WHERE r1 = 1 AND r2 = 1""",
       STEPS.format(src="boxes WHERE score >= 0.1") + f", cur AS ({BOX_D} WHERE score >= 0.5), old AS ({BOX_D} WHERE score >= 0.1), " + _mutual(IOU, 0.8)
       + f""", hi AS (SELECT * FROM rk WHERE r1 = 1 AND r2 = 1), faint AS ({BOX_D} WHERE score < 0.5 AND score >= 0.1),
 free AS (SELECT * FROM old WHERE det_id NOT IN (SELECT prev_id FROM hi)),
 lowp AS (SELECT b.camera_id, b.frame_id, a.det_id AS prev_id, b.det_id AS id, {IOU} AS s FROM st
  JOIN faint b ON b.camera_id = st.camera_id AND b.frame_id = st.frame_id JOIN free a ON a.camera_id = st.camera_id AND a.frame_id = st.prev
  WHERE 1 - {IOU} <= 0.9)""")
def linked_two_stage(t):
    return T.associate_two_stage(boxed(t), "camera_id", "frame_id", "det_id", "box", "score").withColumn("iou", F.round("iou", 6))


@query("J12 V2", "crops", "SELECT camera_id, frame_id, prev_id, id, round(s, 5) AS similarity FROM rk WHERE r1 = 1 AND r2 = 1",
       STEPS.format(src="crops") + ", cur AS (SELECT crop_id AS det_id, camera_id, frame_id, embedding::DOUBLE[] AS e FROM crops), old AS (SELECT * FROM cur), "
       + _mutual("list_cosine_similarity(a.e, b.e)", 0.9))
def linked_by_appearance(t):
    out = T.associate_by_appearance(t.crops, "camera_id", "frame_id", "crop_id", "embedding", 0.9)
    return out.withColumn("similarity", F.round("similarity", 5))


def _bags_people(t):
    c = t.boxes.withColumn("cx", (F.col("x1") + F.col("x2")) / 2.0).withColumn("cy", (F.col("y1") + F.col("y2")) / 2.0)
    bags = c.where(F.col("class_label") == "truck").select("frame_id", F.col("det_id").alias("bag_id"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    people = c.where(F.col("class_label") == "person").select("frame_id", F.col("det_id").alias("person_id"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    return bags, people


BAGS = """c AS (SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM boxes), bp AS (SELECT b.det_id AS bag_id, p.det_id AS person_id,
 sqrt((b.cx - p.cx)^2 + (b.cy - p.cy)^2) AS dist FROM c b JOIN c p USING (frame_id) WHERE b.class_label = 'truck' AND p.class_label = 'person')"""


@query("J13 G4", "boxes", """SELECT b.det_id AS bag_id, coalesce(o.person_id, -1) AS owner_id FROM boxes b LEFT JOIN
 (SELECT bag_id, person_id, row_number() OVER (PARTITION BY bag_id ORDER BY dist, person_id) AS r FROM bp WHERE dist <= 120) o
 ON o.bag_id = b.det_id AND r = 1 WHERE b.class_label = 'truck'""", BAGS)
def bag_owners(t):
    bags, people = _bags_people(t)
    near = S.near_pairs(bags, people, ["frame_id"], 120.0, ("bx", "by"), ("px", "py"))
    best = near.groupBy("bag_id").agg(F.min_by("person_id", F.struct("dist", "person_id")).alias("owner_id"))
    return bags.select("bag_id").join(best, "bag_id", "left").select("bag_id", F.coalesce("owner_id", F.lit(-1)).alias("owner_id"))


@query("J14", "boxes", "SELECT det_id AS bag_id FROM boxes WHERE class_label = 'truck' AND det_id NOT IN (SELECT bag_id FROM bp WHERE dist <= 120)", BAGS)
def unattended_bags(t):
    bags, people = _bags_people(t)
    near = S.near_pairs(bags, people, ["frame_id"], 120.0, ("bx", "by"), ("px", "py"))
    return bags.select("bag_id").join(near, "bag_id", "left_anti")


@query("J15 G1", "boxes", """SELECT a.frame_id, a.det_id AS a, b.det_id AS b, round(sqrt((a.cx - b.cx)^2 + (a.cy - b.cy)^2), 6) AS dist FROM c a JOIN c b
 ON a.frame_id = b.frame_id AND a.det_id < b.det_id WHERE a.class_label = 'person' AND b.class_label = 'person' AND sqrt((a.cx - b.cx)^2 + (a.cy - b.cy)^2) <= 150""", BAGS)
def close_people(t):
    people = t.boxes.where(F.col("class_label") == "person").withColumn("cx", (F.col("x1") + F.col("x2")) / 2.0).withColumn(
        "cy", (F.col("y1") + F.col("y2")) / 2.0)
    return S.close_pairs(people, ["frame_id"], "det_id", "cx", "cy", 150.0).withColumn("dist", F.round("dist", 6))


@query("J16 G3", "boxes", f"""SELECT a.frame_id, a.det_id AS a, b.det_id AS b, round({INTER} / least({AREA.format('a')}, {AREA.format('b')}), 6) AS overlap
 FROM boxes a JOIN boxes b ON a.frame_id = b.frame_id AND a.det_id < b.det_id WHERE a.class_label = 'person' AND b.class_label = 'person'
 AND {INTER} / least({AREA.format('a')}, {AREA.format('b')}) >= 0.35""")
def overlapping_people(t):
    people = boxed(t).where(F.col("class_label") == "person")
    pairs = S.overlap_pairs(people, ["frame_id"], "det_id", "box", G.overlap_of_smaller)
    return pairs.where(F.col("overlap") >= 0.35).withColumn("overlap", F.round("overlap", 6))


ZONES = {"yard": [(10.0, 10.0), (60.0, 10.0), (60.0, 55.0), (10.0, 55.0)], "gate": [(0.0, 60.0), (40.0, 100.0), (80.0, 60.0), (40.0, 80.0)],
         "degenerate": [(0.0, 0.0), (1.0, 1.0)]}
LINES = {"fence": [(30.0, 0.0), (30.0, 100.0)], "slope": [(0.0, 50.0), (100.0, 20.0)]}


def ring_sql(x, y, ring):
    """Strict containment written independently: crossing count over an edge list."""
    edges = list(zip(ring, ring[1:] + ring[:1]))
    odd = " + ".join(f"CASE WHEN (({a[1]} > {y}) <> ({b[1]} > {y})) AND {x} < ({y} - {a[1]}) * {(b[0] - a[0]) / (b[1] - a[1])}::DOUBLE + {a[0]} THEN 1 ELSE 0 END"
                     for a, b in edges if a[1] != b[1])
    touch = " OR ".join(f"(abs({b[0] - a[0]} * ({y} - {a[1]}) - {b[1] - a[1]} * ({x} - {a[0]})) < 1e-9 AND {x} BETWEEN {min(a[0], b[0])} AND {max(a[0], b[0])} "
                        f"AND {y} BETWEEN {min(a[1], b[1])} AND {max(a[1], b[1])})" for a, b in edges)
    return f"(({odd}) % 2 = 1 AND NOT ({touch}))"


@query("J17 G5", "points", " UNION ALL ".join(
    f"SELECT point_id, '{z}' AS zone_id FROM points WHERE {ring_sql('x', 'y', r)}" for z, r in ZONES.items() if len(r) > 2))
def zone_members(t):
    return S.configured_zones(t.points, ZONES, "x", "y").where("inside").select("point_id", "zone_id")


@query("J17 G5", "points", " UNION ALL ".join(
    f"SELECT point_id, '{z}' AS zone_id FROM points WHERE camera_id % 3 = {i} AND {ring_sql('x', 'y', r)}" for i, (z, r) in enumerate(ZONES.items()) if len(r) > 2))
def camera_zone_members(t):
    cams = t.points.select("camera_id").distinct()
    table = [(z, [{"x": x, "y": y} for x, y in r], i) for i, (z, r) in enumerate(ZONES.items()) if len(r) > 2]
    zones = t.spark.createDataFrame(table, "zone_id string, polygon array<struct<x:double,y:double>>, lot int")
    zones = cams.withColumn("lot", (F.col("camera_id") % 3).cast("int")).join(zones, "lot").drop("lot")
    return S.zone_members(t.points, zones, ["camera_id"], "x", "y").select("point_id", "zone_id")


def _orient(a, b, c):
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def meets_sql(p, q, r, s):
    on = lambda a, b, c: f"({c[0]} BETWEEN least({a[0]}, {b[0]}) AND greatest({a[0]}, {b[0]}) AND {c[1]} BETWEEN least({a[1]}, {b[1]}) AND greatest({a[1]}, {b[1]}))"
    o = [_orient(p, q, r), _orient(p, q, s), _orient(r, s, p), _orient(r, s, q)]
    return (f"(({o[0]} * {o[1]} < 0 AND {o[2]} * {o[3]} < 0) OR ({o[0]} = 0 AND {on(p, q, r)}) OR ({o[1]} = 0 AND {on(p, q, s)}) "
            f"OR ({o[2]} = 0 AND {on(r, s, p)}) OR ({o[3]} = 0 AND {on(r, s, q)}))")


LAGGED = ("lg AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM points WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_ms, point_id))")


@query("J18 G6 W1", "points", " UNION ALL ".join(
    f"SELECT point_id, '{n}' AS line_id FROM lg WHERE px IS NOT NULL AND {meets_sql(('px', 'py'), ('x', 'y'), e[0], e[1])}" for n, e in LINES.items()), LAGGED)
def tripwire_crossings(t):
    h = with_history(t.points, ["camera_id", "track_id"], ["ts_ms", "point_id"], ["x", "y"], 2, time_chunk("ts_ms", 86_400_000), "h")
    return S.crossings(h, LINES, back("h", 1), "x", "y").select("point_id", "line_id")


@query("J19", "boxes", f"""SELECT frame_id, track, det_id, round(s, 6) AS iou FROM (SELECT a.frame_id, a.det_id AS track, b.det_id, {IOU} AS s,
 row_number() OVER (PARTITION BY a.det_id ORDER BY {IOU} DESC, b.det_id) AS r FROM trk a JOIN boxes b ON a.frame_id = b.frame_id WHERE {INTER} > 0)
 WHERE r = 1 AND s >= 0.7""", "trk AS (SELECT frame_id, det_id, x1 + 4 AS x1, y1 + 3 AS y1, x2 + 4 AS x2, y2 + 3 AS y2 FROM boxes)")
def labelled_detections(t):
    b = boxed(t)
    moved = t.boxes.select("frame_id", F.col("det_id").alias("track"), G.box(F.col("x1") + 4, F.col("y1") + 3, F.col("x2") + 4, F.col("y2") + 3).alias("tbox"))
    return T.label_detections(moved, b, ["frame_id"], "track", "det_id", "tbox", "box").withColumn("iou", F.round("iou", 6))


@query("J20", "detections", """SELECT h.det_id, count(*) AS rows FROM detections h JOIN detections d ON d.segment_id = h.segment_id AND d.track_id = h.track_id
 WHERE h.confidence >= 0.9 GROUP BY 1""")
def hit_track_rows(t):
    d = t.detections
    hits = d.where(F.col("confidence") >= 0.9).select("det_id", "segment_id", "track_id")
    return hits.join(d.select("segment_id", "track_id"), ["segment_id", "track_id"]).groupBy("det_id").agg(F.count(F.lit(1)).alias("rows"))


@query("J21", "detections", """SELECT g.p_partkey AS gallery_id, g.p_size AS stored, coalesce(n, 0) AS actual, g.p_size = coalesce(n, 0) AS agrees
 FROM part g LEFT JOIN (SELECT gallery_id, count(*) AS n FROM (SELECT l_partkey AS gallery_id FROM lineitem) GROUP BY 1) d ON d.gallery_id = g.p_partkey""")
def sighting_counts(t):
    actual = t.raw("lineitem").groupBy(F.col("l_partkey").alias("gallery_id")).agg(F.count(F.lit(1)).alias("n"))
    stored = t.raw("part").select(F.col("p_partkey").alias("gallery_id"), F.col("p_size").alias("stored"))
    out = stored.join(actual, "gallery_id", "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return out.select("gallery_id", "stored", "actual", (F.col("stored") == F.col("actual")).alias("agrees"))
