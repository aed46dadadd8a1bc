"""Projections and filters."""

from pyspark.sql import functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.functions import geometry as G
from vigilgrid.operators import filters as P
from vigilgrid.operators.ordered import forward_fill

CARRIED = ("array_compact(array(CASE WHEN k % 2 = 0 THEN 'backpack' END, CASE WHEN k % 3 = 0 THEN 'umbrella' END, "
           "CASE WHEN k % 5 = 0 THEN 'hat' END))")
CARRIED_SQL = ("list_filter([CASE WHEN k % 2 = 0 THEN 'backpack' END, CASE WHEN k % 3 = 0 THEN 'umbrella' END, "
               "CASE WHEN k % 5 = 0 THEN 'hat' END], lambda x: x IS NOT NULL)")
FRAME_W, FRAME_H = 640, 480


@query("P1", "alerts", "SELECT id, camera_id FROM alerts WHERE org_id = 3")
def tenant_rows(t):
    return P.for_tenant(t.alerts, 3).select("id", "camera_id")


@query("P1", "alerts", "SELECT id, camera_id FROM alerts WHERE false")
def tenant_missing(t):
    return P.for_tenant(t.alerts, None).select("id", "camera_id")


@query("P2", "cameras", "SELECT camera_id, name FROM cameras WHERE NOT is_deleted")
def live_cameras(t):
    return P.live_rows(t.cameras).select("camera_id", "name")


@query("P3 P4 P5 P7 P8", "detections", """SELECT det_id, class_label, dominant_colour FROM detections
 WHERE class_label IN ('car', 'vehicle') AND lower(dominant_colour) = 'red' AND lower(vehicle_type) = 'suv'
 AND segment_start >= TIMESTAMP '1998-01-01' AND segment_start <= TIMESTAMP '2000-12-31'""")
def red_suvs(t):
    d = t.detections
    c = F.col
    return d.where(P.class_is(c("class_label"), "car")
                   & P.colour_is("Red", False, c("dominant_colour"), c("upper_colour"), c("lower_colour"))
                   & P.style_is(c("vehicle_type"), "suv")
                   & P.started_between(c("segment_start"), "1998-01-01 00:00:00", "2000-12-31 00:00:00")
                   ).select("det_id", "class_label", "dominant_colour")


@query("P3 P4 P7", "detections", """SELECT det_id FROM detections WHERE class_label = 'person'
 AND (lower(upper_colour) = 'blue' OR lower(lower_colour) = 'blue' OR lower(dominant_colour) = 'blue') AND gender_estimate = 'woman'""")
def women_in_blue(t):
    c = F.col
    return t.detections.where(P.class_is(c("class_label"), "person")
                              & P.colour_is("blue", True, c("dominant_colour"), c("upper_colour"), c("lower_colour"))
                              & P.gender_is(c("gender_estimate"), "Woman")).select("det_id")


@query("P6 F11", "alerts", f"SELECT id FROM alerts WHERE list_contains({CARRIED_SQL}, 'backpack') AND list_contains({CARRIED_SQL}, 'hat')")
def carrying_both(t):
    return t.alerts.withColumn("carried", F.expr(CARRIED)).where(P.carries_all(F.col("carried"), ["backpack", "hat"])).select("id")


@query("P6 F12", "alerts", "SELECT id FROM alerts WHERE metadata LIKE '%\"k\"%'")
def carrying_keys(t):
    return t.alerts.where(P.carries_all_json(F.col("metadata"), ["k"])).select("id")


@query("P9 P10", "alerts", """SELECT id FROM alerts WHERE camera_id IN (1, 3, 5) AND start_ms + k * 60000 >= 1704500000000
 AND start_ms <= 1705500000000 AND event_type IN ('click', 'view', 'error') AND event_type <> 'view'""")
def event_vector_filter(t):
    rows = t.alerts.select("id", "camera_id", "event_type", F.col("start_ms").alias("start_time"),
                           (F.col("start_ms") + F.col("k") * 60000).alias("end_time"))
    return rows.where(P.vector_filter("events", [1, 3, 5], 1704500000000, 1705500000000, ["click", "view"],
                                      ["error"], ["view"])).select("id")


@query("P9", "alerts", f"""SELECT id FROM alerts WHERE list_has_any({CARRIED_SQL}, ['backpack', 'umbrella'])
 AND NOT list_contains({CARRIED_SQL}, 'hat') AND start_ms >= 1704500000000""")
def frame_vector_filter(t):
    rows = t.alerts.select("id", "camera_id", F.col("start_ms").alias("timestamp_ms"), F.expr(CARRIED).alias("object_classes"))
    return rows.where(P.vector_filter("frames", None, 1704500000000, None, ["backpack"], ["umbrella"], ["hat"])).select("id")


@query("P9", "detections", "SELECT det_id FROM detections WHERE false")
def vector_filter_no_cameras(t):
    rows = t.detections.select("det_id", F.col("track_id").alias("camera_id"), "class_label",
                               F.col("timestamp_ms").alias("first_seen"), F.col("timestamp_ms").alias("last_seen"))
    return rows.where(P.vector_filter("objects", [])).select("det_id")


@query("P11", "", """SELECT doc_id FROM documents WHERE NOT (lang = 'en' OR contains(lower(text), 'en') OR lang = 'src3' OR contains(lower(text), 'src3')
 OR source = 'src3')""")
def without_words(t):
    d = t.raw("documents").withColumn("classes", F.array("lang", "source"))
    return d.where(P.not_about(F.col("classes"), F.col("text"), ["EN", "src3"])).select("doc_id")


@query("P12", "boxes", """SELECT det_id, class_label FROM boxes
 WHERE score >= CASE WHEN class_label = 'person' THEN 0.4 WHEN class_label IN ('car', 'truck') THEN 0.5 ELSE 0.3 END""")
def above_group_threshold(t):
    return t.boxes.where(F.col("score") >= P.group_threshold(F.col("class_label"))).select("det_id", "class_label")


@query("P12", "boxes", "SELECT class_label, count(*) AS kept FROM boxes WHERE score >= CASE class_label WHEN 'person' THEN 0.42 ELSE 0.45 END GROUP BY 1")
def above_class_threshold(t):
    return t.boxes.where(F.col("score") >= P.class_threshold(F.col("class_label"))).groupBy("class_label").agg(
        F.count(F.lit(1)).alias("kept"))


CLAMPED = f"""cl AS (SELECT det_id, greatest(0, round_even(x1, 0)) AS x1, greatest(0, round_even(y1, 0)) AS y1,
 least({FRAME_W}, round_even(x2, 0)) AS x2, least({FRAME_H}, round_even(y2, 0)) AS y2 FROM boxes)"""


@query("P13", "boxes", f"""SELECT det_id, x1, y1, x2, y2 FROM cl WHERE (x2-x1)*(y2-y1) >= 400
 AND (x2-x1)*(y2-y1) <= 0.6*{FRAME_W}*{FRAME_H} AND (x2-x1) <> 0 AND (y2-y1) <> 0
 AND round((x2-x1)/(y2-y1), 3) BETWEEN 0.15 AND 6.5""", CLAMPED)
def plausible_boxes(t):
    r = t.boxes.select("det_id", G.box(*[F.bround(c) for c in ("x1", "y1", "x2", "y2")]).alias("b"))
    b = F.col("b")
    r = r.withColumn("b", G.box(F.greatest(F.lit(0.0), b["x1"]), F.greatest(F.lit(0.0), b["y1"]),
                                F.least(F.lit(float(FRAME_W)), b["x2"]), F.least(F.lit(float(FRAME_H)), b["y2"])))
    return r.where(P.plausible_box(F.col("b"), FRAME_W, FRAME_H)).select("det_id", "b.*")


@query("P14", "boxes", """SELECT det_id, round(least(greatest(0, (x1 - 0) / (1.0/3)), 1920.0), 4) AS x1, round(least(greatest(0, (y1 - 140) / (1.0/3)), 1080.0), 4) AS y1,
 round(least(greatest(0, (x2 - 0) / (1.0/3)), 1920.0), 4) AS x2, round(least(greatest(0, (y2 - 140) / (1.0/3)), 1080.0), 4) AS y2
 FROM (SELECT det_id, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM boxes)""".replace("(1.0/3)", "(1.0::DOUBLE/3)"))
def restored_boxes(t):
    b = G.unletterbox(G.box("x1", "y1", "x2", "y2"), F.lit(1920), F.lit(1080))
    return t.boxes.select("det_id", b.alias("b")).select("det_id", *[F.round(f"b.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("P15", "alerts", f"SELECT id, coalesce({list(P.TAXONOMY)}[k + 1], 'object') AS label FROM alerts")
def taxonomy_labels(t):
    return t.alerts.select("id", P.taxonomy_label(F.col("k")).alias("label"))


@query("P15", "alerts", "SELECT id, ['person','bicycle','car','motorcycle',NULL,'bus',NULL,'truck'][k + 1] AS label FROM alerts WHERE k IN (0,1,2,3,5,7)")
def target_labels(t):
    return t.alerts.select("id", P.target_label(F.col("k")).alias("label")).where(F.col("label").isNotNull())


FAULT = """faults AS (SELECT det_id, CASE WHEN l IS NULL THEN 'missing field' WHEN cid = 4 THEN 'unknown class' WHEN want <> l THEN 'label mismatch'
 WHEN score < 0.35 THEN 'low confidence' WHEN x1 <> floor(x1) OR y1 <> floor(y1) OR x2 <> floor(x2) OR y2 <> floor(y2) THEN 'bbox not integer' END AS fault
 FROM (SELECT *, CASE WHEN frame_id % 11 = 0 THEN NULL ELSE class_label END AS l, ['person','bicycle','car','motorcycle',NULL,'bus',NULL,'truck'][cid + 1] AS want
 FROM (SELECT *, CASE class_label WHEN 'person' THEN frame_id % 2 * 4 WHEN 'car' THEN 2 ELSE 7 END AS cid FROM boxes)))"""


def _faults(t):
    cid = F.when(F.col("class_label") == "person", F.col("frame_id") % 2 * 4).when(F.col("class_label") == "car", 2).otherwise(7)
    label = F.when(F.col("frame_id") % 11 == 0, None).otherwise(F.col("class_label"))
    return t.boxes.select("det_id", P.record_fault(
        cid, label, F.col("score"), [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col("frame_id"), F.col("camera_id")]).alias("fault"))


@query("P16", "boxes", "SELECT fault, count(*) AS records FROM faults WHERE fault IS NOT NULL GROUP BY 1", FAULT)
def record_faults(t):
    return _faults(t).where(F.col("fault").isNotNull()).groupBy("fault").agg(F.count(F.lit(1)).alias("records"))


@query("P16", "boxes", "SELECT det_id FROM faults WHERE fault IS NULL", FAULT)
def valid_records(t):
    return _faults(t).where(F.col("fault").isNull()).select("det_id")


@query("P18", "alerts", "SELECT id, NOT (value < 100 AND k < 20) AND NOT (k / 100 > 0.95 + 0.03) AS is_acceptable FROM alerts")
def quality_verdicts(t):
    return t.alerts.select("id", P.acceptable_quality(F.col("value"), F.col("k"), F.col("k") / 100).alias("is_acceptable"))


@query("P19", "boxes", "SELECT DISTINCT frame_id FROM boxes WHERE frame_id % 20 = 0")
def sampled_frames(t):
    return t.boxes.where(P.sampled(F.col("frame_id"), F.lit(30.0))).select("frame_id").distinct()


@query("P19", "boxes", "SELECT DISTINCT frame_id FROM boxes WHERE frame_id = 1 OR frame_id % 5 = 0")
def tracked_frames(t):
    return t.boxes.where(P.every_fifth(F.col("frame_id"))).select("frame_id").distinct()


@query("P21 O1", "detections", "SELECT det_id, confidence FROM detections WHERE track_id = 7 ORDER BY confidence DESC, det_id")
def facet_by_track(t):
    return t.detections.where(F.col("track_id") == 7).select("det_id", "confidence").orderBy(F.desc("confidence"), "det_id")


@query("W13", "boxes", """SELECT f.camera_id, f.frame_id, last_value(s.n IGNORE NULLS) OVER (PARTITION BY f.camera_id ORDER BY f.frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS detections
 FROM (SELECT DISTINCT camera_id, frame_id FROM boxes) f LEFT JOIN (SELECT camera_id, frame_id, count(*) AS n FROM boxes WHERE frame_id = 1 OR frame_id % 5 = 0 GROUP BY 1, 2) s
 ON s.frame_id = f.frame_id AND s.camera_id = f.camera_id""")
def carried_detections(t):
    per_frame = t.boxes.groupBy("camera_id", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    seen = F.when(P.every_fifth(F.col("frame_id")), F.col("n"))
    filled = forward_fill(per_frame, ["camera_id"], ["frame_id"], seen, F.floor(F.col("frame_id") / 10_000), "detections")
    return filled.select("camera_id", "frame_id", "detections")
