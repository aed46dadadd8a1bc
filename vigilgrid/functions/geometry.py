"""Planar geometry as column expressions; boxes are structs x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

UNION_FLOOR = 1e-6


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[
        (F.col(v) if isinstance(v, str) else v).cast("double").alias(n)
        for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))
    ])


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2.0


def centre_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2.0


def centre(b: Column) -> Column:
    return F.struct(centre_x(b).alias("x"), centre_y(b).alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def intersection_area(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union with a floor under the union."""
    inter = intersection_area(a, b)
    return inter / F.greatest(F.lit(UNION_FLOOR), area(a) + area(b) - inter)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 for degenerate boxes."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(intersection_area(a, b) / smaller)


def pad(b: Column, px: float, frame_w: Column | float, frame_h: Column | float) -> Column:
    fw, fh = _col(frame_w), _col(frame_h)
    return box(F.greatest(F.lit(0.0), b["x1"] - px), F.greatest(F.lit(0.0), b["y1"] - px),
               F.least(fw, b["x2"] + px), F.least(fh, b["y2"] + px))


def clamp(b: Column, frame_w: Column | float, frame_h: Column | float) -> Column:
    fw, fh = _col(frame_w), _col(frame_h)
    zero = F.lit(0.0)
    return box(F.least(F.greatest(zero, b["x1"]), fw), F.least(F.greatest(zero, b["y1"]), fh),
               F.least(F.greatest(zero, b["x2"]), fw), F.least(F.greatest(zero, b["y2"]), fh))


def normalised(b: Column, frame_w: Column | float, frame_h: Column | float) -> Column:
    """Pixel box to the unit square; a degenerate box becomes the full frame."""
    fw, fh = _col(frame_w), _col(frame_h)
    bad = (width(b) <= 0) | (height(b) <= 0)
    unit = box(b["x1"] / fw, b["y1"] / fh, b["x2"] / fw, b["y2"] / fh)
    full = box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    return F.when(bad, full).otherwise(unit)


def unletterbox(b: Column, frame_w: Column, frame_h: Column, target: int = 640) -> Column:
    """Padded square model input back to source pixels, clamped to the frame."""
    scale = F.least(F.lit(float(target)) / frame_w, F.lit(float(target)) / frame_h)
    left = F.floor((F.lit(target) - F.bround(frame_w * scale)) / 2)
    top = F.floor((F.lit(target) - F.bround(frame_h * scale)) / 2)
    raw = box((b["x1"] - left) / scale, (b["y1"] - top) / scale,
              (b["x2"] - left) / scale, (b["y2"] - top) / scale)
    return clamp(raw, frame_w.cast("double"), frame_h.cast("double"))


def within_polygon(px: Column, py: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Strict containment in a configured polygon, unrolled into plain arithmetic per edge."""
    inside = F.lit(False)
    on_edge = F.lit(False)
    ring = _open_ring(vertices)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = (py - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crosses = ((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < at)
            inside = inside != crosses
        cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        on_edge = on_edge | (
            (F.abs(cross) < 1e-9)
            & px.between(min(x1, x2), max(x1, x2)) & py.between(min(y1, y2), max(y1, y2))
        )
    return inside & ~on_edge


def within_polygon_array(px: Column, py: Column, polygon: Column) -> Column:
    """Strict containment where the polygon is an array<struct<x,y>> column."""
    n = F.size(polygon)
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.element_at(polygon, i + 1).alias("a"),
                           F.element_at(polygon, F.when(i + 2 > n, 1).otherwise(i + 2)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (py - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) + a["x"]
        return F.coalesce(((a["y"] > py) != (b["y"] > py)) & (px < at), F.lit(False))

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        return ((F.abs(cross) < 1e-9)
                & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
                & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])))

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, touches)


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_intersect(p: tuple, q: tuple, r: tuple, s: tuple) -> Column:
    """Whether segment pq meets segment rs; touching and collinear overlap count."""
    p, q, r, s = [tuple(_col(v) for v in t) for t in (p, q, r, s)]
    d1, d2 = _turn(*p, *q, *r), _turn(*p, *q, *s)
    d3, d4 = _turn(*r, *s, *p), _turn(*r, *s, *q)

    def on(a, b, c):
        return (c[0].between(F.least(a[0], b[0]), F.greatest(a[0], b[0]))
                & c[1].between(F.least(a[1], b[1]), F.greatest(a[1], b[1])))

    proper = (d1 != d2) & (d3 != d4)
    touching = (((d1 == 0) & on(p, q, r)) | ((d2 == 0) & on(p, q, s))
                | ((d3 == 0) & on(r, s, p)) | ((d4 == 0) & on(r, s, q)))
    return proper & (d1 * d2 <= 0) & (d3 * d4 <= 0) | touching


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _open_ring(vertices):
    ring = [(float(x), float(y)) for x, y in vertices]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))
