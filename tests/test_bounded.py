"""Steps that must not grow faster than their input: what they write, list and hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilgrid.functions import geometry as G
from vigilgrid.operators import crowds, greedy, nearest as N, spatial as S, tracker
from vigilgrid.streaming.chains import _peak


def test_tracks_that_never_end_are_walked_once(spark, monkeypatch):
    """One box per second that overlaps the last one: every chunk's tracks depend on all chunks before."""
    written = []
    monkeypatch.setattr(greedy, "cut_lineage", lambda df, cut=greedy.cut_lineage: written.append(1) or cut(df))
    rows = [(c, 1000 * s, 100 * s + c, 0.0, 0.0, 10.0, 10.0, 0.9, [1.0, float(s)]) for c in (1, 2, None) for s in range(40) if c is not None]
    df = spark.createDataFrame(rows, "camera_id bigint, ts_ms bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>")
    got = tracker.track_boxes(df, ["camera_id"], F.floor(F.col("ts_ms") / 4_000)).collect()
    assert {(r.camera_id, r.track_id) for r in got} == {(1, 1), (2, 2)} and max(r.hits for r in got) == 40 and len(got) == 80
    assert len(written) == 1


def test_first_overlaps_are_the_least_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(f), int(i), float(x), float(y)) for f in range(12) for i, (x, y) in enumerate(rng.uniform(0, 120, (int(rng.integers(0, 30)), 2)))]
    df = spark.createDataFrame(rows, "f int, id bigint, x double, y double").withColumn("box", G.box(F.col("x"), F.col("y"), F.col("x") + 20, F.col("y") + 20))
    pairs = S.overlap_pairs(df, ["f"], "id", "box", G.overlap_of_smaller, ["x"]).where("overlap >= 0.35").collect()
    want = {f: min((r.a, r.b, r.overlap, r.x_a, r.x_b) for r in pairs if r.f == f) for f in {r.f for r in pairs}}
    got = {r.f: (r.a, r.b, r.overlap, r.x_a, r.x_b) for r in S.first_overlaps(df, ["f"], "id", "box", 0.35, ["x"]).collect()}
    assert got == want and 3 < len(got)


def test_density_lists_no_spread_cells(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(x), float(y)) for g in range(5) for x, y in rng.uniform(-5, 330, (40 if g else 900, 2))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    out = crowds.density_peak(df, ["g"], "x", "y", 320, 240)
    for r in out.collect():
        x, y = (np.array([p[i] for p in rows if p[0] == r.g]) for i in (1, 2))
        assert r.max_density == pytest.approx(_peak(x, y, 320, 240), abs=1e-9)
    assert "Generate" not in out._jdf.queryExecution().sparkPlan().toString()


def test_cells_touch_as_their_points_do():
    rng = np.random.default_rng(7)
    cells = [rng.uniform(0, 7, (int(n), 2)) + rng.integers(-2, 3, 2) * 7 for n in rng.integers(1, 40, 300)] + [np.full((1, 2), np.nan)]
    pairs = [(i, (i * 7 + 3) % len(cells)) for i in range(len(cells))]
    lists = [pa.array([cells[p[s]][:, c].tolist() for p in pairs], pa.list_(pa.float64())) for s in (0, 1) for c in (0, 1)]
    batch = pa.record_batch([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), *lists], ["a", "b", "_ax", "_ay", "_xs", "_ys"])
    got = {tuple(r.values()) for b in S._touching(10.0)([batch]) for r in b.to_pylist()}
    near = lambda a, b: (np.hypot(*(a[:, None] - b).transpose(2, 0, 1)) <= 10.0).any()
    assert got == {p for p in pairs if near(cells[p[0]], cells[p[1]])} and 20 < len(got) < len(pairs)


@pytest.mark.parametrize("k", [1, 3, 10, 500])
def test_best_of_rows_beside_sorting(k):
    rng = np.random.default_rng(k)
    scores = np.round(rng.normal(size=(40, 300)), 1)  # many equal ones
    scores[rng.random(scores.shape) < 0.1] = -np.inf
    pid, cid = np.arange(40) + 5, np.sort(rng.choice(9999, 300, replace=False))
    want = [(p, c, s) for p, row in zip(pid, scores) for s, c in sorted(zip(-row, cid))[:k] for s in [-s] if s >= 0.2]
    assert list(zip(*N._best(scores, pid, cid, k, 0.2))) == want


def test_blocks_meet_in_groups_of_bounded_size(spark):
    df = spark.range(50).select(F.col("id").alias("a"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    top = N.nearest(df, df.withColumnRenamed("a", "b"), 2, (), "a", "b", probe_rows=7, candidate_rows=9)
    plan = top._jdf.queryExecution().sparkPlan().toString()
    assert "CoGroups" in plan and "MapInArrow" not in plan
    assert {r.a for r in top.where("a = b").collect()} == set(range(50))
