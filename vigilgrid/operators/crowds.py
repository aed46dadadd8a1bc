"""Group statistics and density of nearby people."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilgrid.operators.spatial import proximity_components

CELL_PX = 10
KERNEL = 15


def kernel_weights(size: int = KERNEL) -> list[float]:
    """One-dimensional Gaussian with the deviation OpenCV derives from the kernel size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def clusters(people: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str, radius: float = 150.0,
             at_least: int = 10) -> DataFrame:
    """Members of groups of ``at_least`` people linked by steps of at most ``radius``."""
    enough = people.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    members = proximity_components(people.join(enough.drop("_n"), list(keys), "left_semi"), keys, id_col, x, y, radius)
    big = members.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return members.join(big.drop("_n"), "component", "left_semi")


def cluster_stats(members: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str) -> DataFrame:
    return members.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("people_count"), F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"),
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"),
        F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))


def member_lists(members: DataFrame, groups: DataFrame, on: Sequence[str], id_col: str) -> DataFrame:
    """Member ids of the few ``groups`` worth an alert; one frame's people at most per list."""
    kept = members.join(groups.select(*on), list(on), "left_semi")
    return kept.groupBy(*on).agg(F.array_sort(F.collect_list(id_col)).alias("track_ids"))


def density_peak(members: DataFrame, keys: Sequence[str], x: str, y: str, frame_w: int, frame_h: int) -> DataFrame:
    """Largest value of the smoothed 10 px count grid per group, borders mirrored.

    A counted cell adds its share to the 225 cells around it, and through its mirror images to
    those near a border. A group's counted cells come together as one row, at most the cells of the grid.
    """
    grid_w, grid_h = frame_w // CELL_PX, frame_h // CELL_PX

    def bin_of(c: str, n: int) -> Column:
        return F.least(F.greatest(F.floor((F.col(c) / CELL_PX).cast("double")), F.lit(0)), F.lit(n - 1))

    counts = members.groupBy(*keys, bin_of(x, grid_w).alias("_cx"), bin_of(y, grid_h).alias("_cy")).agg(
        F.count(F.lit(1)).alias("_n"))
    packed = counts.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_cx").cast("int").alias("x"), F.col("_cy").cast("int").alias("y"), F.col("_n").alias("n"))).alias("_r"))
    flat = packed.select(*keys, F.col("_r.x").alias("_xs"), F.col("_r.y").alias("_ys"), F.col("_r.n").alias("_ns"))
    across, down = _shares(grid_w), _shares(grid_h)

    def peaks(batches):
        for pdf in batches:
            found = [_highest(np.asarray(xs), np.asarray(ys), np.asarray(ns, float), across, down) for xs, ys, ns in zip(pdf["_xs"], pdf["_ys"], pdf["_ns"])]
            yield pdf[list(keys)].assign(max_density=np.array(found, float))

    kinds = {f.name: f for f in counts.schema.fields}
    return flat.mapInPandas(peaks, T.StructType([*(kinds[k] for k in keys), T.StructField("max_density", T.DoubleType())]))


def _shares(n: int) -> np.ndarray:
    """What a count in a row of the grid adds to every row, through its images behind both borders too."""
    out, half = np.zeros((n, n)), KERNEL // 2
    for s in range(n):
        for image in [s, *([-s] if s >= 1 else []), *([2 * (n - 1) - s] if s <= n - 2 else [])]:
            for i, w in enumerate(kernel_weights()):
                if 0 <= (at := image + i - half) < n:
                    out[s, at] += w
    return out


def _highest(xs: np.ndarray, ys: np.ndarray, n: np.ndarray, across: np.ndarray, down: np.ndarray) -> float:
    """Largest smoothed value of counts ``n`` in cells, within the rows and columns that they reach."""
    half = KERNEL // 2
    cols, rows = slice(max(0, xs.min() - half), xs.max() + half + 1), slice(max(0, ys.min() - half), ys.max() + half + 1)
    if len(xs) > across.shape[0]:
        # Many cells: fold them into the grid first, so the product stays as small as the grid.
        grid = np.zeros((down.shape[0], across.shape[0]))
        np.add.at(grid, (ys, xs), n)
        return float((down[:, rows].T @ grid @ across[:, cols]).max())
    return float(((down[ys][:, rows] * n[:, None]).T @ across[xs][:, cols]).max())
