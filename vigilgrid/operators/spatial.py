"""Spatial joins keyed on grid cells, so they plan as equi joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilgrid.functions import geometry as G
from vigilgrid.operators.graph import connected_components
from vigilgrid.session import cut_lineage


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float,
               left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """Rows of both sides sharing ``keys`` and at most ``radius`` apart, with ``dist``.

    The left side is copied to the nine cells around it, the right side stays in its own, so the
    smaller side belongs on the left. Column names of the sides, other than keys, must differ.
    """
    keys = list(keys)
    step = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    lx, ly, rx, ry = (F.col(c) for c in (*left_xy, *right_xy))
    spread = (left.withColumn("_gx", F.explode(F.transform(step, lambda d: G.cell(lx, radius) + d)))
              .withColumn("_gy", F.explode(F.transform(step, lambda d: G.cell(ly, radius) + d))))
    homed = right.withColumn("_gx", G.cell(rx, radius)).withColumn("_gy", G.cell(ry, radius))
    return (spread.join(homed, keys + ["_gx", "_gy"])
            .withColumn("dist", G.distance(lx, ly, rx, ry))
            .where(F.col("dist") <= radius).drop("_gx", "_gy"))


def close_pairs(points: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str,
                radius: float) -> DataFrame:
    """Each unordered pair of points at most ``radius`` apart: ``keys, a, b, dist`` with a < b."""
    one = points.select(*keys, F.col(id_col).alias("a"), F.col(x).alias("_ax"), F.col(y).alias("_ay"))
    two = points.select(*keys, F.col(id_col).alias("b"), F.col(x).alias("_bx"), F.col(y).alias("_by"))
    return (near_pairs(one, two, keys, radius, ("_ax", "_ay"), ("_bx", "_by"))
            .where(F.col("a") < F.col("b")).select(*keys, "a", "b", "dist"))


def overlapping_boxes(left: DataFrame, right: DataFrame, keys: Sequence[str], left_box: str,
                      right_box: str, cell_px: float = 256.0) -> DataFrame:
    """Rows whose boxes intersect, each pair once.

    Boxes go to every cell they touch; a pair is kept only in the cell holding the upper-left
    corner of its intersection, which needs no duplicate removal afterwards.
    """
    keys = list(keys)

    def cells(df: DataFrame, b: str) -> DataFrame:
        c = F.col(b)
        return (df.withColumn("_gx", F.explode(F.sequence(G.cell(c["x1"], cell_px), G.cell(c["x2"], cell_px))))
                .withColumn("_gy", F.explode(F.sequence(G.cell(c["y1"], cell_px), G.cell(c["y2"], cell_px)))))

    a, b = F.col(left_box), F.col(right_box)
    return (cells(left, left_box).join(cells(right, right_box), keys + ["_gx", "_gy"])
            .where((G.cell(F.greatest(a["x1"], b["x1"]), cell_px) == F.col("_gx"))
                   & (G.cell(F.greatest(a["y1"], b["y1"]), cell_px) == F.col("_gy"))
                   & (G.intersection_area(a, b) > 0)).drop("_gx", "_gy"))


def overlap_pairs(boxes: DataFrame, keys: Sequence[str], id_col: str, box: str,
                  measure=G.iou, carry: Sequence[str] = ()) -> DataFrame:
    """Unordered intersecting pairs within ``keys``: ``a, b, overlap`` plus carried columns.

    ``carry`` columns appear twice, suffixed ``_a`` and ``_b``.
    """
    one = boxes.select(*keys, F.col(id_col).alias("a"), F.col(box).alias("_box_a"),
                       *[F.col(c).alias(f"{c}_a") for c in carry])
    two = boxes.select(*keys, F.col(id_col).alias("b"), F.col(box).alias("_box_b"),
                       *[F.col(c).alias(f"{c}_b") for c in carry])
    return (overlapping_boxes(one, two, keys, "_box_a", "_box_b").where(F.col("a") < F.col("b"))
            .withColumn("overlap", measure(F.col("_box_a"), F.col("_box_b")))
            .drop("_box_a", "_box_b"))


def zone_members(points: DataFrame, zones: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Points strictly inside a zone; ``zones`` has ``keys, zone_id, polygon``."""
    return points.join(zones, list(keys)).where(
        G.within_polygon_array(F.col(x), F.col(y), F.col("polygon"))).drop("polygon")


def configured_zones(points: DataFrame, zones: dict[str, Sequence[tuple[float, float]]],
                     x: str, y: str, name: str = "zone_id") -> DataFrame:
    """One row per point and configured zone with ``inside``; zones with under 3 vertices are ignored.

    Zones are configuration, so they unroll into the plan as arithmetic.
    """
    tests = [F.struct(F.lit(z).alias(name), G.within_polygon(F.col(x), F.col(y), ring).alias("inside"))
             for z, ring in sorted(zones.items()) if len(ring) >= 3]
    return points.withColumn("_z", F.explode(F.array(*tests))).select(
        *points.columns, f"_z.{name}", "_z.inside")


def crossings(points: DataFrame, lines: dict[str, Sequence[tuple[float, float]]],
              prev: Column, x: str, y: str, name: str = "line_id") -> DataFrame:
    """Steps from ``prev`` (struct x, y) to the current point that meet a configured line."""
    tests = [F.struct(F.lit(n).alias(name),
                      G.segments_intersect((prev["x"], prev["y"]), (F.col(x), F.col(y)), *ends).alias("hit"))
             for n, ends in sorted(lines.items()) if len(ends) == 2]
    return (points.where(prev.isNotNull())
            .withColumn("_l", F.explode(F.filter(F.array(*tests), lambda t: t["hit"])))
            .select(*points.columns, f"_l.{name}"))


def proximity_components(points: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str,
                         radius: float) -> DataFrame:
    """Label each point with its component under "at most ``radius`` apart" within ``keys``.

    Adds ``component``, the smallest id of the group; ids must be unique across the table.
    Cells of side radius/sqrt(2) hold only mutually close points, so a cell is one node, named by its
    first point, and two cells link as soon as any of their points are close. A cell's points come as one
    row. Rows that share an id link the cells they lie in.
    """
    keys = list(keys)
    side = radius / 2 ** 0.5
    at = keys + ["_gx", "_gy"]
    p = points.select(*keys, F.col(id_col).alias("node"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("node IS NOT NULL")
    p = p.withColumn("_gx", G.cell(F.col("_x"), side)).withColumn("_gy", G.cell(F.col("_y"), side))
    cells = cut_lineage(p.dropna(subset=at).groupBy(*at).agg(
        F.min("node").alias("hub"), F.collect_list("_x").alias("_xs"), F.collect_list("_y").alias("_ys")))
    steps = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"))
                      for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)])
    reach = cells.withColumn("_s", F.explode(steps)).select(
        *keys, (F.col("_gx") + F.col("_s.dx")).alias("_gx"), (F.col("_gy") + F.col("_s.dy")).alias("_gy"),
        F.col("hub").alias("a"), F.col("_xs").alias("_ax"), F.col("_ys").alias("_ay"))
    met = reach.join(cells.withColumnRenamed("hub", "b"), at).select("a", "b", "_ax", "_ay", "_xs", "_ys")
    node = points.schema[id_col].dataType
    links = met.mapInArrow(_touching(radius), T.StructType([T.StructField("a", node), T.StructField("b", node)]))
    homed = cut_lineage(p.join(cells.select(*at, "hub"), at, "left").select("node", F.coalesce("hub", "node").alias("hub")))
    repeated = homed.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node")
    shared = homed.where("node <> hub").join(repeated, "node", "left_semi").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = connected_components(homed.select(F.col("hub").alias("node")).distinct(), links.unionByName(shared))
    labels = homed.join(roots.withColumnRenamed("node", "hub"), "hub").select(F.col("node").alias(id_col), "component")
    return points.join(labels, id_col)


#: Pairs of points that are measured at once.
MEASURED = 1 << 20


def _touching(radius: float):
    """Names of the pairs of cells of which two points are at most ``radius`` apart."""
    def close(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> bool:
        # Only points that reach the other cell's bounds can matter; a hair more for rounding.
        far = radius * (1 + 1e-9)
        for _ in range(2):
            own = np.hypot(np.maximum(0.0, np.maximum(bx.min() - ax, ax - bx.max())), np.maximum(0.0, np.maximum(by.min() - ay, ay - by.max()))) <= far
            ax, ay, bx, by = bx, by, ax[own], ay[own]
            if not len(bx):
                return False
        width = max(1, MEASURED // len(bx))
        return any(_near(ax[i:i + width, None], ay[i:i + width, None], bx, by, radius).any() for i in range(0, len(ax), width))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(c) for c in ("_ax", "_ay", "_xs", "_ys")]
            values = [np.asarray(c.flatten()) for c in lists]
            sizes = [np.asarray(pc.list_value_length(c)) for c in (lists[0], lists[2])]
            starts = [np.cumsum(n) - n for n in sizes]
            hit = np.zeros(batch.num_rows, bool)
            lone = (sizes[0] == 1) & (sizes[1] == 1)
            i, j = starts[0][lone], starts[1][lone]
            hit[lone] = _near(values[0][i], values[1][i], values[2][j], values[3][j], radius)
            for r in np.flatnonzero(~lone):
                a, b = (slice(s[r], s[r] + n[r]) for s, n in zip(starts, sizes))
                hit[r] = close(values[0][a], values[1][a], values[2][b], values[3][b])
            keep = pa.array(hit)
            yield pa.record_batch([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _near(ax, ay, bx, by, radius: float) -> np.ndarray:
    return np.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= radius


def first_overlaps(boxes: DataFrame, keys: Sequence[str], id_col: str, box: str, at_least: float, carry: Sequence[str] = ()) -> DataFrame:
    """Of every ``keys`` the least pair ``a, b`` by ``overlap_pairs`` with ``overlap_of_smaller`` of ``at_least``.

    Ids are searched in order until a pair is found, so a crowded frame costs about its boxes, not its
    pairs. A frame's boxes come as one row.
    """
    keys, edges = list(keys), ["x1", "y1", "x2", "y2"]
    kept = [id_col, *carry]
    rows = boxes.select(*keys, *kept, *[F.col(box)[e].cast("double").alias(f"_{e}") for e in edges]).dropna(subset=[*keys, id_col, *[f"_{e}" for e in edges]])
    names = [f"_{e}" for e in edges]
    framed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(id_col, *names, *carry))).alias("_r")).where(F.size("_r") > 1)
    flat = framed.select(*keys, "_r", *[F.col(f"_r.{n}").alias(n) for n in (id_col, *names)])
    kinds = {f.name: f for f in flat.schema.fields}
    found = T.StructType([*(kinds[k] for k in keys), kinds["_r"], T.StructField("_i", T.IntegerType()), T.StructField("_j", T.IntegerType())])

    def run(batches):
        for pdf in batches:
            pairs = [_first_pair(np.asarray(ids), *(np.asarray(e, float) for e in es), at_least) for ids, *es in zip(*(pdf[c] for c in (id_col, *names)))]
            some = [p is not None for p in pairs]
            out = pdf.loc[some, [*keys]].assign(_i=np.array([p[0] for p in pairs if p], np.int32), _j=np.array([p[1] for p in pairs if p], np.int32))
            yield out

    at = flat.select(*keys, id_col, *names).mapInPandas(run, T.StructType([f for f in found.fields if f.name != "_r"]))
    ends = framed.join(at, keys).select(*keys, F.element_at("_r", F.col("_i") + 1).alias("_a"), F.element_at("_r", F.col("_j") + 1).alias("_b"))
    whole = lambda s: G.box(*(F.col(f"{s}.{n}") for n in names))
    return ends.select(*keys, F.col(f"_a.{id_col}").alias("a"), F.col(f"_b.{id_col}").alias("b"), *[F.col(f"{s}.{c}").alias(f"{c}{s}") for c in carry for s in ("_a", "_b")],
                       G.overlap_of_smaller(whole("_a"), whole("_b")).alias("overlap"))


def _first_pair(ids: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, at_least: float) -> tuple[int, int] | None:
    """Places of the first pair of sorted ids that overlap enough."""
    n, i, width = len(ids), 0, 1
    area = (x2 - x1) * (y2 - y1)
    while i < n - 1:
        a, b = slice(i, min(i + width, n - 1)), slice(i + 1, n)
        w = np.maximum(0.0, np.minimum(x2[a, None], x2[b]) - np.maximum(x1[a, None], x1[b]))
        h = np.maximum(0.0, np.minimum(y2[a, None], y2[b]) - np.maximum(y1[a, None], y1[b]))
        shared, smaller = w * h, np.minimum(area[a, None], area[b])
        ok = (shared > 0) & (smaller > 0) & (ids[b] > ids[a, None])
        ok &= np.divide(shared, smaller, out=np.zeros_like(shared), where=smaller > 0) >= at_least
        met = np.flatnonzero(ok.any(axis=1))
        if len(met):
            # Equal ids are one: of their rows the first with the least partner counts.
            same = [k for k in met if ids[i + k] == ids[i + met[0]]]
            k = min(same, key=lambda k: int(np.flatnonzero(ok[k])[0]))
            return int(i + k), int(i + 1 + np.flatnonzero(ok[k])[0])
        i, width = a.stop, min(2 * width, max(1, MEASURED // n))
    return None
