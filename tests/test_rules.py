"""Hand-made rows for detection, tracking and alert rules."""

import json

from pyspark.sql import functions as F

from vigilgrid.functions import geometry as G
from vigilgrid.operators import filters as P, tracks as T
from vigilgrid.plans import alerts as A, ingest

TRACK = "camera_id string, track_id bigint, class_id int, ts_ms bigint, x1 double, y1 double, x2 double, y2 double"


def tracks(spark, rows):
    return spark.createDataFrame([("cam", *r) for r in rows], TRACK)


def test_class_thresholds(spark):
    rows = [("person", .45), ("person", .35), ("car", .55), ("car", .45), ("cup", .32), ("cup", .25)]
    df = spark.createDataFrame(rows, "label string, score double")
    kept = df.where(F.col("score") >= P.group_threshold(F.col("label"))).select("label").collect()
    assert sorted(r.label for r in kept) == ["car", "cup", "person"]


def test_suppression_keeps_best_and_other_classes(spark):
    rows = [(1, "a", .9, 0., 0., 10., 10.), (2, "a", .8, 1., 1., 11., 11.), (3, "a", .7, 50., 50., 60., 60.), (4, "b", .6, 0., 0., 10., 10.)]
    df = spark.createDataFrame(rows, "id bigint, c string, score double, x1 double, y1 double, x2 double, y2 double")
    df = df.withColumn("box", G.box("x1", "y1", "x2", "y2")).withColumn("frame", F.lit(1))
    assert sorted(r.id for r in T.suppress_overlaps(df, ["frame", "c"], "id", "box", "score").collect()) == [1, 3, 4]


def test_letterbox(spark):
    # 800x400 source in a 640 square: scale 0.8, 160 px above the picture.
    df = spark.createDataFrame([(160., 100., 320., 448.)], "x1 double, y1 double, x2 double, y2 double")
    b = df.select(G.unletterbox(G.box("x1", "y1", "x2", "y2"), F.lit(800), F.lit(400)).alias("b")).first().b
    assert [b.x1, b.y1, b.x2, b.y2] == [200.0, 0.0, 400.0, 360.0]


def test_two_objects_keep_one_id_each_through_occlusion(spark):
    rows = []
    for f in range(150):
        x = 50 + 1.5 * f
        if not 150 <= x <= 180:
            rows.append((1000 + f, f, "person", x, 200., x + 50, 260.))
        x = 500 - 2. * f
        if not 250 <= x <= 290:
            rows.append((5000 + f, f, "car", x, 320., x + 100, 360.))
    df = spark.createDataFrame(rows, "id bigint, frame bigint, label string, x1 double, y1 double, x2 double, y2 double")
    df = df.withColumn("box", G.box("x1", "y1", "x2", "y2")).withColumn("camera", F.lit("c")).withColumn(
        "ts_ms", (F.col("frame") * 1000 / 30).cast("long"))
    out = T.build_tracks(df, "camera", "frame", "id", "box", "ts_ms").join(df.select("id", "label"), "id")
    ids = {r.label: r.n for r in out.groupBy("label").agg(F.countDistinct("track_id").alias("n")).collect()}
    assert ids == {"person": 1, "car": 1} and out.select("track_id").distinct().count() == 2


def test_lifecycle(spark):
    rows = spark.createDataFrame([("c", 1, 100), ("c", 1, 200), ("c", 1, 900), ("c", 2, 100), ("c", 2, 900)], "cam string, track int, ts bigint")
    out = T.lifecycle(rows, ["cam", "track"], "ts", 100, 2, 1000)
    got = {(r.track, r.ts): (r.state, r.recovered) for r in out.collect()}
    assert got == {(1, 100): ("tentative", False), (1, 200): ("confirmed", False), (1, 900): ("confirmed", True),
                   (2, 100): ("tentative", False), (2, 900): ("tentative", False)}
    end = lambda at: {r.track: r.status for r in T.lifecycle_end(out, ["cam", "track"], "ts", at, 100, 1000).collect()}
    assert end(1500) == {1: "lost", 2: "deleted"} and end(2500) == {1: "deleted", 2: "deleted"}


def test_suspicious_dwell(spark):
    df = spark.createDataFrame([("c", 1, "person", 1000), ("c", 1, "person", 6000), ("c", 2, "car", 1000), ("c", 2, "car", 6000)],
                               "camera_id string, track_id int, class_label string, ts_ms bigint")
    got = {r.track_id: (r.dwell_s, r.is_suspicious) for r in A.suspicious_dwell(df, limits={"person": 3., "vehicle": 10., "object": 5.}).collect()}
    assert got == {1: (5.0, True), 2: (5.0, False)}


def test_crowd(spark):
    rows = [(i, 0, 1000, 100. + 4 * i, 100., 120. + 4 * i, 150.) for i in range(12)] + [(99, 0, 1000, 1500., 900., 1520., 950.)]
    got = A.crowd(tracks(spark, rows), {"count_threshold": 10, "density_threshold": 100.0}).collect()
    assert len(got) == 1
    meta = json.loads(got[0].metadata)
    assert meta["people_count"] == 12 and meta["track_ids"] == list(range(12)) and meta["max_density"] > 0


def test_abandoned_bag(spark):
    rows = []
    for ts in (800, 900, 1000, 1100, 1700, 2300):
        rows.append((7, 32, ts, 200., 200., 250., 250.))
        near = ts <= 1000
        rows.append((1, 0, ts, *((210., 210., 260., 260.) if near else (900., 900., 950., 950.))))
    rules = {"abandoned_time_threshold_ms": 1000}
    got = A.suppress(A.abandoned(tracks(spark, rows), rules)).collect()
    assert [(r.ts_ms, json.loads(r.metadata)["item_type"]) for r in got] == [(2300, "suitcase")]


def test_loitering(spark):
    zone = {"lounge_area": [(0, 0), (100, 0), (100, 100), (0, 100)]}
    rows = [(1, 0, 1000, 40., 40., 60., 60.), (1, 0, 2200, 40., 40., 60., 60.)]
    got = A.loitering(tracks(spark, rows), {"dwell_threshold_ms": 1000, "zones": zone}).collect()
    assert [(r.ts_ms, r.zone_id) for r in got] == [(2200, "lounge_area")]
    left = rows[:1] + [(1, 0, 1500, 140., 40., 160., 60.)] + rows[1:]
    assert A.loitering(tracks(spark, left), {"dwell_threshold_ms": 1000, "zones": zone}).count() == 0


def test_zone_edge_is_outside(spark):
    df = spark.createDataFrame([(0., 50.), (50., 50.), (100., 100.)], "x double, y double")
    ring = [(0, 0), (100, 0), (100, 100), (0, 100)]
    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    got = df.select(G.within_polygon(F.col("x"), F.col("y"), ring).alias("a"), G.within_polygon_array(F.col("x"), F.col("y"), poly).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(False, False), (True, True), (False, False)]


def test_tripwire(spark):
    rows = [(1, 0, 1000, 80., 40., 100., 60.), (1, 0, 1100, 100., 40., 120., 60.)]
    got = A.perimeter(tracks(spark, rows), {"lines": {"gate": [(100., 0.), (100., 200.)]}}).collect()
    assert [(r.zone_id, json.loads(r.metadata)["breach_type"]) for r in got] == [("gate", "tripwire_crossing")]


def test_wrong_direction(spark):
    rows = [(1, 2, 1000 + 100 * i, 200. - 20 * i, 50., 220. - 20 * i, 70.) for i in range(3)]
    assert A.wrong_direction(tracks(spark, rows), {"allowed_direction": (1., 0.), "history_frames": 3}).count() == 1
    assert A.wrong_direction(tracks(spark, rows), {"allowed_direction": (-1., 0.), "history_frames": 3}).count() == 0


def test_fight(spark):
    rows = []
    for i, (ax, bx) in enumerate(((100., 160.), (110., 150.), (150., 160.))):
        rows += [(1, 0, 1000 + i, ax, 100., ax + 50, 200.), (2, 0, 1000 + i, bx, 100., bx + 50, 200.)]
    got = A.fight(tracks(spark, rows), {"acceleration_threshold": 5.0, "overlap_threshold": 0.2}).collect()
    assert [r.ts_ms for r in got] == [1002] and json.loads(got[0].metadata)["track_ids"] == [1, 2]


def test_suppression_window(spark):
    df = spark.createDataFrame([("c", "t", "z", t, i) for i, t in enumerate((1000, 5000, 31000, 36000, 66001))],
                               "camera_id string, event_type string, zone_id string, ts_ms bigint, `order` int")
    assert sorted(r.ts_ms for r in A.suppress(df).collect()) == [1000, 36000, 66001]


def test_detectors_can_be_added(spark):
    A.register("any", lambda tracks, rules: tracks.select(
        "camera_id", F.lit("seen").alias("event_type"), F.lit("LOW").alias("severity"), "ts_ms", F.lit("").alias("zone_id"),
        F.col("track_id").alias("order"), F.lit('{"name": "x", "speed": 1, "nested": {"identity_card": 2, "safe_key": 3}}').alias("metadata")))
    rows = [(1, 0, 1000, 0., 0., 1., 1.), (2, 0, 1500, 0., 0., 1., 1.)]
    out = A.publishable(A.detect(tracks(spark, rows), {"any": {}})).collect()
    assert len(out) == 1
    payload = json.loads(out[0].payload)
    assert payload["metadata"] == {"speed": 1, "nested": {"safe_key": 3}} and payload["timestamp_ms"] == 1000 and payload["zone_id"] is None
    del A.DETECTORS["any"]


def test_camera_status(spark):
    rows = [("a", 1000, 30., 30., 0), ("b", 90_000, 30., 30., 0), ("c", 90_000, 15., 30., 0), ("d", 90_000, 5., 30., 0), ("e", 90_000, 30., 30., 20)]
    df = spark.createDataFrame(rows, "camera_id string, ts_ms bigint, fps double, target_fps double, errors int")
    got = {r.camera_id: r.status for r in A.camera_status(df, 100_000).collect()}
    assert got == {"a": "offline", "b": "healthy", "c": "degraded", "d": "critical", "e": "critical"}


def test_lockout_clears_counter(spark):
    times = [0, 10_000, 20_000, 30_000, 40_000, 50_000, 1_000_000, 1_000_001]
    df = spark.createDataFrame([("u", t) for t in times], "user string, ts bigint")
    assert [r.locked_ms for r in ingest.lockouts(df, ["user"], "ts").collect()] == [40_000]
