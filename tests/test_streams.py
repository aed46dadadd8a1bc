"""Streams fed in several micro-batches give the batch answer."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from vigilgrid.plans import alerts as A
from vigilgrid.streaming import chains as C, rollups as R, sources as S, stateful as T

START = 1_700_000_000_000  # the first watermark is the epoch, so rows at it would be late
SCHEMA = "camera_id string, zone_id string, ts_ms bigint, ts timestamp"


def feed(spark, tmp_path, times, parts=4):
    """Write one file per stretch of time, oldest first, and read them one per micro-batch."""
    folder = tmp_path / "in"
    for i, chunk in enumerate(np.array_split(np.sort(times), parts)):
        df = spark.createDataFrame([(f"c{t % 3}", "z", int(t)) for t in chunk], "camera_id string, zone_id string, ts_ms bigint")
        path = folder / f"part={i}"
        df.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_suppression_over_batches(spark, tmp_path):
    times = np.random.default_rng(1).integers(0, 3_000_000, 500)
    stream = T.suppress(feed(spark, tmp_path, times), ["camera_id", "zone_id"], 30_000)
    R.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.camera_id, r.ts_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame([(f"c{t % 3}", "t", "z", int(t), 0) for t in times], "camera_id string, event_type string, zone_id string, ts_ms bigint, `order` int")
    assert got == {(r.camera_id, r.ts_ms) for r in A.suppress(batch).collect()}


def test_silence_is_reported_once_the_watermark_passes(spark, tmp_path):
    times = START + np.array([0, 1_000, 2_000, 90_000_000, 180_000_000])
    stream = T.camera_silence(feed(spark, tmp_path, times, 5).withColumn("camera_id", F.lit("c")), 30_000)
    R.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.ts_ms - START, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "online"), (32_001, "offline"), (90_000_000, "online"), (90_030_001, "offline"), (180_000_000, "online")]


def test_camera_verdicts_are_raised_cleared_and_timed(spark, tmp_path):
    """Frames every second, a fall to one frame in two seconds, errors, silence beyond the watermark, and a return that remembers old errors."""
    steady = [START + 500 * i for i in range(20)]
    slow = [START + 10_000 + 1_500 * i for i in range(6)]
    wrong = [START + 20_000 + i for i in range(5)]
    back = [START + 90_000_000, START + 90_000_100, START + 180_000_000]
    rows = [(t, False) for t in steady + slow] + [(t, True) for t in wrong] + [(t, False) for t in back]
    folder = tmp_path / "in"
    for i, part in enumerate((rows[:12], rows[12:27], rows[27:31], rows[31:33], rows[33:])):
        df = spark.createDataFrame([("c", *r) for r in part], "camera_id string, ts_ms bigint, is_error boolean").withColumn("ts", F.timestamp_millis("ts_ms"))
        df.coalesce(1).write.parquet(str(folder / f"part={i}"))
        for f in (folder / f"part={i}").glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    R.run(T.camera_verdicts(stream, 2.0, ttl_ms=10**9), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [(r.ts_ms - START, r.status) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts_ms").collect()]
    # The first window holds two frames only.
    assert got == [(0, "healthy"), (500, "degraded"), (1_000, "healthy"), (11_500, "degraded"), (47_501, "offline"), (90_000_000, "degraded"), (90_030_101, "offline"), (180_000_000, "degraded")]


def test_restart_continues_from_checkpoint(spark, tmp_path):
    times = START + np.array([0, 10_000, 20_000, 40_000, 50_000])
    source = feed(spark, tmp_path, times, 5).withColumn("camera_id", F.lit("c"))
    for _ in range(2):
        R.run(T.suppress(source, ["camera_id", "zone_id"], 30_000), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.ts_ms - START for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 40_000]


def test_layout_of_files_does_not_matter(spark, tmp_path):
    times = START + np.random.default_rng(2).integers(0, 90 * 86_400_000, 600)
    rows = spark.createDataFrame([(f"c{t % 3}", "z", int(t)) for t in times], "camera_id string, zone_id string, ts_ms bigint").withColumn("ts", F.timestamp_millis("ts_ms"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(24, F.xxhash64("ts_ms")).write.parquet(str(tmp_path / "many.parquet"))
    (single,) = (tmp_path / "one").glob("*.parquet")
    answers = []
    for i, path in enumerate((str(single), str(tmp_path / "many.parquet"))):
        stream = T.suppress(S.file_stream(spark, path, SCHEMA), ["camera_id", "zone_id"], 6 * 3_600_000)
        R.run(stream, str(tmp_path / f"out{i}"), str(tmp_path / f"cp{i}"))
        answers.append({(r.camera_id, r.ts_ms) for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect()})
    assert answers[0] == answers[1] and len(answers[0]) > 300


def test_rows_later_than_the_watermark_fail_a_drain(spark, tmp_path):
    for i, ms in enumerate((START + 10 * 86_400_000, START + 20 * 86_400_000, START)):
        path = tmp_path / "in" / f"part={i}"
        spark.createDataFrame([("c", "z", ms)], "camera_id string, zone_id string, ts_ms bigint").withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    stream = T.suppress(S.file_stream(spark, str(tmp_path / "in"), SCHEMA, 1), ["camera_id", "zone_id"])
    with pytest.raises(RuntimeError, match="1 rows came later"):
        R.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"))


WIDTH, WINDOW = 60_000, 5 * 60_000


@pytest.fixture(scope="module")
def scene(spark):
    """People and bags of two cameras over 160 moments, two rows a moment: camera, track, class, time, place."""
    rng = np.random.default_rng(4)
    rows = []
    for camera in (1, 2):
        place = rng.uniform(0, 260, (14, 2))
        for m in range(160):
            place[:10] += rng.normal(0, 14, (10, 2))
            place[10:] += rng.normal(0, 6 if m % 40 < 3 else 0.4, (4, 2))
            for track in range(14):
                if rng.random() < 0.9:
                    for part in (5_000, 35_000):
                        x, y = place[track] + rng.normal(0, 0.3, 2)
                        rows.append((camera, track, 0 if track < 10 else (26, 30, 32, 2)[track - 10], START + m * WIDTH + part, float(x), float(y)))
    return spark.createDataFrame(rows, "camera_id bigint, track_id bigint, class_id int, ts_ms bigint, cx double, cy double")


RULES = {"acceleration_threshold": 12.0, "density_threshold": 60.0, "count_threshold": 3, "proximity_threshold": 60.0, "abandoned_time_threshold_ms": 4 * WIDTH}


def found(alerts, until):
    """Alerts of closed moments, numbers of their metadata rounded."""
    def plain(v):
        return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v

    rows = alerts.where(F.col("ts_ms") + WIDTH <= until).collect()
    return sorted((r.camera_id, r.event_type, r.severity, r.ts_ms, str(r.zone_id), str(sorted((k, str(plain(v))) for k, v in json.loads(r.metadata).items()))) for r in rows)


@pytest.mark.parametrize("name", ["fight", "crowd", "abandoned"])
def test_chains_equal_the_batch_rules_on_shuffled_files(spark, scene, tmp_path, name):
    # 24 files, rows up to ten minutes from their place; six files a micro-batch, so memories outlive batches.
    mixed = scene.withColumn("ts", F.timestamp_millis("ts_ms")).withColumn("part", F.ntile(24).over(Window.orderBy(
        F.col("ts_ms") + F.pmod(F.xxhash64("camera_id", "track_id", "ts_ms"), F.lit(600_000)))))
    for part in range(1, 25):
        path = tmp_path / "in" / f"f={part}"
        mixed.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_000_000 + part, 1_000_000 + part))
    points = S.file_stream(spark, str(tmp_path / "in"), "camera_id bigint, track_id bigint, class_id int, ts_ms bigint, cx double, cy double, ts timestamp", 6)
    lateness = "30 minutes"
    chain = {"fight": lambda: C.fights(points, RULES, WIDTH, 20.0, WINDOW, lateness=lateness),
             "crowd": lambda: C.crowds(points, RULES, WIDTH, 640, 480, WINDOW, lateness=lateness),
             "abandoned": lambda: C.abandoned(points, RULES, WIDTH, 20.0, WINDOW, lateness=lateness)}[name]()
    R.run(chain, str(tmp_path / "out"), str(tmp_path / "cp"))
    until = scene.agg(F.max("ts_ms")).first()[0] - 30 * 60_000
    means = scene.groupBy("camera_id", "track_id", "class_id", (F.floor(F.col("ts_ms") / WIDTH) * WIDTH).cast("long").alias("ts_ms")).agg(F.avg("cx").alias("x"), F.avg("cy").alias("y"))
    boxes = means.select("camera_id", "track_id", "class_id", "ts_ms", (F.col("x") - 20).alias("x1"), (F.col("y") - 20).alias("y1"), (F.col("x") + 20).alias("x2"), (F.col("y") + 20).alias("y2"))
    batch = A.crowd(boxes, RULES, 640, 480, WINDOW) if name == "crowd" else A.suppress(A.DETECTORS[name](boxes, RULES), WINDOW)
    want = found(batch, until)
    assert len(want) > 5 and found(spark.read.schema(chain.schema).parquet(str(tmp_path / "out")), until) == want


def test_kept_table_stays_small_and_right_over_fifty_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    folder, table, want = tmp_path / "kept", R.KeptTable(spark, str(tmp_path / "kept"), ["org_id"]), {}
    for batch in range(50):
        changed = {(int(d), int(h), int(o)) for d, h, o in zip(rng.integers(batch // 20, batch // 20 + 2, 6), rng.integers(0, 24, 6), rng.integers(0, 3, 6))}
        rows = [(f"2024-01-0{d + 1} {h:02d}:00:00", o, batch * 100 + o) for d, h, o in changed]
        df = spark.createDataFrame(rows, "bucket string, org_id int, event_count int").withColumn("bucket", F.to_timestamp("bucket"))
        for _ in range(2 if batch % 7 == 0 else 1):  # a micro-batch that is written again changes nothing
            table.write(df, batch)
        want.update({(b, o): n for b, o, n in rows})
    got = {(r.bucket.strftime("%Y-%m-%d %H:%M:%S"), r.org_id): r.event_count for r in table.rows().collect()}
    assert got == want
    days = len({b[:10] for b, _ in want})
    assert len(list(folder.glob("day=*/version=*/*.parquet"))) <= 2 * days


@pytest.mark.parametrize("name", ["live_crowds", "live_fights"])
def test_chains_bring_their_state_store(spark, tmp_path, name):
    """A session that names Spark's default store, which refuses transformWithState, runs the chains and keeps its setting."""
    from tools.check import compare
    from vigilgrid.catalog import load

    import duckdb
    rows = [(i, START + 21_600_000 * (i // 4) + i % 4, 10 * (i % 4), float(60 * (i // 4 % 2) + i % 4)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, ms bigint, user_id bigint, value double").select(
        "event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit('{"k": 5}').alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    entry, before = load()[name], spark.conf.get(R.STORE_SETTING)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(R.STORE_SETTING, plain)
    try:
        verdict, n = compare(entry.run(spark, str(tmp_path)), con, entry.sql)
        assert verdict == "ok" and n > 0
        assert spark.conf.get(R.STORE_SETTING) == plain
    finally:
        spark.conf.set(R.STORE_SETTING, before)


def test_a_chain_keeps_few_state_partitions(spark, tmp_path):
    """A stream with a store of its own opens stores by cores, not by the session's shuffle partitions, which stay."""
    from vigilgrid.streaming import chains as C

    rows = [(START + 1000 * i, i % 3) for i in range(60)]
    spark.createDataFrame(rows, "ts_ms bigint, camera_id bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts_ms bigint, camera_id bigint").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ts_ms"))
    counts = stream.withWatermark("ts", "1 second").groupBy(F.window("ts", "10 seconds").alias("w"), "camera_id").agg(F.count(F.lit(1)).alias("n"))
    before = spark.conf.get(R.PARTS_SETTING)
    spark.conf.set(R.PARTS_SETTING, "40")
    try:
        R.run(counts.select("camera_id", "n"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), store=C.STORE)
        assert spark.conf.get(R.PARTS_SETTING) == "40"
    finally:
        spark.conf.set(R.PARTS_SETTING, before)
    assert len([d for d in (tmp_path / "checkpoint" / "state" / "0").iterdir() if d.name.isdigit()]) <= 8
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 60 - 10


def test_a_chain_leaves_no_store_open(spark, tmp_path):
    """Stores of a stream with a store of its own close with its tasks; left open, a few streams pass the limit of open files."""
    jvm = spark._jvm.java.lang.ProcessHandle.current().pid()

    def manifests():
        links = [f"/proc/{jvm}/fd/{fd}" for fd in os.listdir(f"/proc/{jvm}/fd")]
        return {os.readlink(at) for at in links if os.path.islink(at) and "MANIFEST" in os.readlink(at)}

    rows = [(START + 1000 * i, i % 3) for i in range(60)]
    spark.createDataFrame(rows, "ts_ms bigint, camera_id bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts_ms bigint, camera_id bigint").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ts_ms"))
    counts = stream.withWatermark("ts", "1 second").groupBy(F.window("ts", "10 seconds").alias("w"), "camera_id").agg(F.count(F.lit(1)).alias("n"))
    before, setting = manifests(), spark.conf.get(R.UNLOAD_SETTING)
    R.run(counts.select("camera_id", "n"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), store=C.STORE)
    assert not manifests() - before
    assert spark.conf.get(R.UNLOAD_SETTING) == setting
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 60 - 10


def test_the_meetings_of_one_frame_equal_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(1, 12))
        rows = pd.DataFrame({"track_id": np.sort(rng.choice(50, n, False)), "cx": rng.uniform(0, 120, n), "cy": rng.uniform(0, 120, n), "acceleration": 1.0, "ts": pd.Timestamp(0),
                             "class_id": rng.choice([0, 26], n)})
        side = lambda c, i, j: max(0.0, 40.0 - abs(rows[c][i] - rows[c][j]))
        pairs = [(rows["track_id"][i], rows["track_id"][j]) for i in range(n) for j in range(i + 1, n) if side("cx", i, j) * side("cy", i, j) / 1600.0 >= 0.35]
        assert [(r[0], r[4]) for r in C._first_overlap(rows, 20.0, 0.35)] == pairs[:1]
        bags, people = rows[rows["class_id"] == 26], rows[rows["class_id"] == 0]
        assert C._attended(rows, 30.0).tolist() == [bool((np.hypot(people["cx"] - b.cx, people["cy"] - b.cy) <= 30.0).any()) for b in bags.itertuples()]


def _all_pairs(x, y, radius):
    label, near = np.arange(len(x)), np.hypot(x[:, None] - x, y[:, None] - y) <= radius
    while True:
        least = np.where(near, label, len(x)).min(axis=1)
        if (least == label).all():
            return label
        label = least[least]


def test_the_groups_of_one_frame_equal_all_pairs():
    rng = np.random.default_rng(21)
    for _ in range(150):
        n, radius = int(rng.integers(1, 90)), float(rng.choice([0.0, 1.0, 15.0, 40.0]))
        x, y = rng.uniform(-200, 300, n), rng.uniform(-60, 60, n)
        if rng.random() < 0.5:
            x, y = np.round(x / 15) * 15, np.round(y / 15) * 15  # exact steps and equal places
        assert C._groups(x, y, radius).tolist() == _all_pairs(x, y, radius).tolist()
    assert C._groups(np.array([0.0, np.nan, 1.0]), np.array([0.0, 0.0, 1.0]), 5.0).tolist() == [0, 1, 0]


def test_a_crowded_frame_takes_memory_by_its_people():
    import tracemalloc

    rng = np.random.default_rng(22)
    for width in (500.0, 50_000.0):  # one dense crowd, and many small ones
        x, y = rng.uniform(0, width, 5_000), rng.uniform(0, width, 5_000)
        tracemalloc.start()
        C._groups(x, y, 15.0)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30 << 20  # all pairs of them take 200 MB at a time


def test_the_tracked_stream_writes_what_it_shows(monkeypatch):
    """The averages of 64 numbers that a track carries are not written with every row."""
    from types import SimpleNamespace
    from vigilgrid.catalog import live as L

    drained = []
    monkeypatch.setattr(L, "_drained", lambda t, df, **options: drained.append(df) or df)
    monkeypatch.setattr(L.C, "live_tracks", lambda *a, **k: "tracks")
    monkeypatch.setattr(L, "shown_tracks", lambda rows: f"shown {rows}")
    monkeypatch.setattr(L, "timed_boxes", lambda t, boxes: boxes)
    monkeypatch.setattr(L, "crop_vectors", lambda t: None, raising=False)
    monkeypatch.setattr(L.S, "file_stream", lambda *a: SimpleNamespace(createOrReplaceTempView=lambda name: None))
    lines = SimpleNamespace(dtypes=[("l_orderkey", "bigint")])
    spark = SimpleNamespace(read=SimpleNamespace(parquet=lambda path: lines), sql=lambda text: "boxes")
    L.live_tracked_boxes(SimpleNamespace(spark=spark, sf_dir="/x"))
    assert drained == ["shown tracks"]
