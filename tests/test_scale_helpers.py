"""Chunked, blocked and iterative operators against plain Python, with chunk and block sizes small
enough that every boundary case occurs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from vigilgrid.functions import geometry as G
from vigilgrid.operators import folds, greedy, ordered, tracks as T
from vigilgrid.operators.graph import connected_components, labelled
from vigilgrid.operators.nearest import nearest
from vigilgrid.operators.spatial import proximity_components
from vigilgrid.plans.reports import exact_percentiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"key": rng.choice(["hot", "hot", "hot", "warm", "cold"], 3000), "ts": rng.integers(0, 400_000, 3000), "id": np.arange(3000),
                        "v": rng.integers(0, 100, 3000)})
    return pdf, spark.createDataFrame(pdf)


def test_history_equals_window(rows):
    _, df = rows
    h = ordered.with_history(df, ["key"], ["ts", "id"], ["v"], 4, ordered.time_chunk("ts", 700), "h")
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(-3, 0)
    want = df.withColumn("w", F.collect_list("v").over(w)).select("id", "w")
    assert h.join(want, "id").where(~F.col("h.v").eqNullSafe(F.col("w"))).count() == 0


@pytest.mark.parametrize("current", [True, False])
def test_forward_fill_equals_window(rows, current):
    _, df = rows
    value = F.when(F.col("v") < 5, F.col("v"))
    got = ordered.forward_fill(df, ["key"], ["ts", "id"], value, ordered.time_chunk("ts", 900), "f", current)
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    want = df.withColumn("w", F.last(value, True).over(w)).select("id", "w")
    assert got.join(want, "id").where(~F.col("f").eqNullSafe(F.col("w"))).count() == 0


def test_trailing_count(rows):
    pdf, df = rows
    got = {r.id: r.n for r in ordered.trailing_count(df, ["key"], "ts", 500, "n", 700).collect()}
    for key, part in pdf.groupby("key"):
        for r in part.head(60).itertuples():
            assert got[r.id] == ((part.ts <= r.ts) & (part.ts > r.ts - 500)).sum()


@pytest.mark.parametrize("chunk", [1500, 7000, 10 ** 6])
def test_chain_anchors_fixed_gap(rows, chunk):
    pdf, df = rows
    got = {(r.key, r.ts) for r in greedy.chain_anchors(df, ["key"], "ts", greedy.fixed_gap(1000), 1001, chunk_ms=chunk).collect()}
    want = set()
    for key, part in pdf.groupby("key"):
        last = None
        for t in sorted(part.ts):
            if last is None or t - last > 1000:
                want.add((key, t))
                last = t
    assert got == want


def test_chain_anchors_burst(rows):
    pdf, df = rows
    got = {(r.key, r.ts) for r in greedy.chain_anchors(df, ["key"], "ts", greedy.burst_then_pause(5, 600, 900), 1500, 600, chunk_ms=1500).where("label = 1").collect()}
    want = set()
    for key, part in pdf.groupby("key"):
        opened, n, until = None, 0, -1
        for t in sorted(part.ts):
            if t < until:
                continue
            if n == 0 or t - opened >= 600:
                opened, n = t, 0
            n += 1
            if n == 5:
                want.add((key, opened))
                until, n = t + 900, 0
    assert got == want


def test_near_duplicates_across_chunks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 60, 40)
    values = [int(base[rng.integers(40)]) ^ (1 << int(rng.integers(60))) ^ (1 << int(rng.integers(60))) for _ in range(600)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "stream string, i bigint, h bigint")
    got = sorted(r.i for r in folds.drop_near_duplicates(df, ["stream"], "i", "h", F.floor(F.col("i") / 50), 4, 20).collect())
    kept, want = [], []
    for i, v in enumerate(values):
        if all(bin(v ^ k).count("1") > 4 for k in kept[-20:]):
            kept.append(v)
            want.append(i)
    assert got == want


def test_moving_average_across_chunks(spark):
    rng = np.random.default_rng(6)
    vecs = rng.standard_normal((300, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    df = spark.createDataFrame([("k", i, [float(x) for x in v]) for i, v in enumerate(vecs)], "k string, i bigint, e array<double>")
    got = folds.moving_average(df, ["k"], "i", "e", F.floor(F.col("i") / 100)).first().embedding
    mean = vecs[0]
    for v in vecs[1:]:
        mean = 0.9 * mean + 0.1 * v
        mean /= np.linalg.norm(mean)
    assert np.allclose(got, mean, atol=1e-12)


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 5)])
def test_nearest_is_exact_in_blocks(spark, blocks, monkeypatch):
    from vigilgrid.operators import nearest as module

    monkeypatch.setattr(module, "BLOCKS_PER_SALT", 2)
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((30, 6)), rng.standard_normal((50, 6))
    p = spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(a)], "probe_id bigint, g bigint, embedding array<double>")
    c = spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(b)], "candidate_id bigint, g bigint, embedding array<double>")
    got = {}
    for r in nearest(p, c, 3, ["g"], probe_rows=blocks[0], candidate_rows=blocks[1]).collect():
        got.setdefault(r.probe_id, {})[r["rank"]] = r.candidate_id
    ua, ub = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    for i in range(30):
        js = [j for j in range(50) if j % 2 == i % 2]
        want = sorted(js, key=lambda j: -ua[i] @ ub[j])[:3]
        assert [got[i][k] for k in (1, 2, 3)] == want


def test_percentiles(spark, rows):
    pdf, df = rows
    got = {r.key: (r.p50, r.p95) for r in exact_percentiles(df, ["key"], "ts", {"p50": 0.5, "p95": 0.95}).collect()}
    for key, part in pdf.groupby("key"):
        assert np.allclose(got[key], np.percentile(part.ts, [50, 95]))


def test_long_chain_is_one_component(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"))
    edges = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[i] == i for i in range(300, 400))


@pytest.mark.parametrize("order", ["falling", "shuffled"])
def test_component_rounds_are_logarithmic(spark, order):
    n = 4096
    ids = np.arange(n)[::-1] if order == "falling" else np.random.default_rng(3).permutation(n)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:])], "a bigint, b bigint")
    got, rounds = labelled(spark.range(n).select(F.col("id").alias("node")), edges)
    assert got.where("component <> 0").isEmpty() and got.count() == n and rounds <= 2 * np.log2(n)


def test_proximity_components(spark):
    rng = np.random.default_rng(8)
    pts = rng.uniform(0, 900, (250, 2))
    df = spark.createDataFrame([(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id bigint, f int, x double, y double")
    got = {r.id: r.component for r in proximity_components(df, ["f"], "id", "x", "y", 60.0).collect()}
    root = list(range(250))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(250):
        for j in range(i):
            if i % 2 == j % 2 and np.hypot(*(pts[i] - pts[j])) <= 60.0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(250)}


def test_suppression_equals_loop(spark):
    rng = np.random.default_rng(9)
    n = 300
    xy, score = rng.uniform(0, 200, (n, 2)), rng.integers(0, 50, n) / 50
    rows = [(i, i % 3, float(score[i]), float(x), float(y), float(x) + 60, float(y) + 60) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "id bigint, f int, score double, x1 double, y1 double, x2 double, y2 double").withColumn("box", G.box("x1", "y1", "x2", "y2"))
    got = {r.id for r in T.suppress_overlaps(df, ["f"], "id", "box", "score").collect()}
    kept = []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        def iou(j):
            w, h = max(0, 60 - abs(xy[i][0] - xy[j][0])), max(0, 60 - abs(xy[i][1] - xy[j][1]))
            return w * h / (7200 - w * h)
        if all(i % 3 != j % 3 or iou(j) <= 0.45 for j in kept):
            kept.append(i)
    assert got == set(kept)


@pytest.mark.parametrize("draw", [lambda g, n: g.normal(0, 1e-3, n), lambda g, n: 10.0 ** g.uniform(-9, 9, n), lambda g, n: g.integers(0, 3, n) * 1.0,
                                  lambda g, n: np.full(n, 7.5), lambda g, n: 5.0 + g.random(n)])
@pytest.mark.parametrize("n", [1, 2, 37, 60_000])
def test_percentiles_of_any_distribution(spark, draw, n):
    values = draw(np.random.default_rng(n), n)
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "v": values})).union(spark.createDataFrame([("b", 1.0), ("b", None)], "key string, v double"))
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.key: r for r in exact_percentiles(df, ["key"], "v", points).collect()}
    assert [got["a"][n] for n in points] == pytest.approx(np.quantile(values, list(points.values())).tolist(), rel=1e-12)
    assert [got["b"][n] for n in points] == [1.0] * 5


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components_joined_nearby_first_are_the_same(spark, kind):
    """Whatever the columns that edges are joined by first, also when groups cut components or have no value."""
    rng = np.random.default_rng(12)
    edges = [(int(a), int(b), int(n) if n < 9 else None) for a, b, n in zip(rng.integers(0, 400, 330), rng.integers(0, 400, 330), rng.integers(0, 10, 330))]
    edges += [(1000 + i, 1001 + i, i // 20) for i in range(200)] + [(7, 7, 1)]
    df = spark.createDataFrame(edges, "a bigint, b bigint, n int").withColumns({"a": F.col("a").cast(kind), "b": F.col("b").cast(kind)})
    nodes = spark.range(1300).select(F.col("id").cast(kind).alias("node"))
    plain = sorted(map(tuple, connected_components(nodes, df).collect()))
    assert sorted(map(tuple, connected_components(nodes, df, ["n"]).collect())) == plain and len(plain) == 1300


def test_only_what_groups_share_is_joined_in_rounds(spark, monkeypatch):
    from vigilgrid.operators import graph

    left, rounds = [], graph.labelled
    monkeypatch.setattr(graph, "labelled", lambda nodes, edges: left.append(edges.count()) or rounds(nodes, edges))
    edges = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.floor(F.col("id") / 1000).alias("n"))
    nodes = spark.range(5001).select(F.col("id").alias("node"))
    assert connected_components(nodes, edges, ["n"]).where("component <> 0").isEmpty()
    assert left == [4]
