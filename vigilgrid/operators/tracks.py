"""Boxes and tracks: suppression, frame-to-frame association, lifecycle and motion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vigilgrid.functions import geometry as G, vectors as V
from vigilgrid.operators import ordered
from vigilgrid.operators.graph import connected_components
from vigilgrid.operators.ordered import back, forward_fill, with_history
from vigilgrid.operators.spatial import overlap_pairs, overlapping_boxes
from vigilgrid.session import cut_lineage

#: Cells in which boxes of a camera's moments meet: few of a size, so few boxes lie in more than one.
MEET_PX = 1024.0
#: Slots in which ends and starts of runs meet, as a multiple of the longest bridge.
SLOT_BRIDGES = 4
#: Frames of a camera, and slots, whose links are joined in one task before runs and tracks meet across them.
NEAR_FRAMES, NEAR_SLOTS = 10_000, 100
#: Pairs of boxes that a task measures at once.
MEASURED = 1 << 20
EDGES = ("x1", "y1", "x2", "y2")


def suppress_overlaps(boxes: DataFrame, keys: Sequence[str], id_col: str, box: str, score: str,
                      limit: float = 0.45) -> DataFrame:
    """Greedy suppression per ``keys`` (frame and class): best score first, drop IoU above ``limit``.

    Runs as rounds over the overlap pairs of all frames at once: a box none of whose better
    overlapping boxes is still open is kept, boxes overlapping a kept one go. The result equals
    the sequential loop; equal scores keep the smaller id first.
    """
    pairs = overlap_pairs(boxes, keys, id_col, box, carry=[score]).where(F.col("overlap") > limit)
    a_wins = F.col(f"{score}_a") >= F.col(f"{score}_b")
    beats = cut_lineage(pairs.select(F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("better"),
                                     F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("worse")))
    dropped = beats.select(F.col("worse").alias(id_col)).limit(0)
    while True:
        blocked = beats.select(F.col("worse").alias("better")).distinct()
        kept = beats.select("better").distinct().join(blocked, "better", "left_anti")
        losers = cut_lineage(beats.join(kept, "better").select(F.col("worse").alias(id_col)).distinct())
        if losers.isEmpty():
            break
        dropped = dropped.union(losers)
        gone = losers.withColumnRenamed(id_col, "better")
        beats = cut_lineage(
            beats.join(kept, "better", "left_anti").join(gone, "better", "left_anti")
            .join(losers.withColumnRenamed(id_col, "worse"), "worse", "left_anti")
            .select("better", "worse"))
    return boxes.join(dropped, id_col, "left_anti")


def previous_frame(boxes: DataFrame, camera: str, frame: str, frames_per_chunk: int = 100_000) -> DataFrame:
    """Distinct (camera, frame) with the camera's frame before it as ``prev_frame``."""
    frames = boxes.select(camera, frame).distinct()
    hist = with_history(frames, [camera], [frame], [frame], 2,
                        F.floor(F.col(frame) / frames_per_chunk), "_h")
    return hist.select(camera, frame, back("_h", 1)[frame].alias("prev_frame"))


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's best; ties go to the smaller partner id."""
    best_r = Window.partitionBy(left).orderBy(F.col(score).desc(), F.col(right))
    best_l = Window.partitionBy(right).orderBy(F.col(score).desc(), F.col(left))
    ranked = pairs.withColumn("_best_r", F.row_number().over(best_r)).withColumn("_best_l", F.row_number().over(best_l))
    return ranked.where("_best_r = 1 AND _best_l = 1").drop("_best_r", "_best_l")


def associate_by_overlap(boxes: DataFrame, camera: str, frame: str, id_col: str, box: str,
                         max_cost: float = 0.8) -> DataFrame:
    """Link boxes of consecutive frames of a camera when 1 - IoU is at most ``max_cost``.

    Mutual best matches, so where two boxes contest one partner the result may differ from an
    optimal assignment. Returns ``camera, frame, prev_id, id, iou``.

    Boxes are shuffled once: all frames of a stretch of a camera meet in one task. The boxes of a stretch's
    first and last frame come out too, and meet those of the stretches beside it.
    """
    rows = boxes.select(F.col(camera).alias("_camera"), F.floor(F.col(frame) / NEAR_FRAMES).alias("_stretch"), F.col(frame).alias("_frame"), F.col(id_col).alias("_id"),
                        *[F.col(box)[e].cast("double").alias(f"_{e}") for e in EDGES]).dropna(subset=["_camera", "_frame"])
    at = ["_camera", "_stretch"]
    kinds = [("_kind", T.IntegerType())] + [(f.name, f.dataType) for f in rows.schema] + [("_prev", rows.schema["_id"].dataType), ("_iou", T.DoubleType())]
    meet = lambda df, ends: df.groupBy(*at).applyInArrow(_meeting(max_cost, ends), T.StructType([T.StructField(*k) for k in kinds]))
    inside = cut_lineage(meet(rows, True))
    last = inside.where("_kind = 2")
    onward = last.select(*at).distinct().withColumn("_next", F.lead("_stretch").over(Window.partitionBy("_camera").orderBy("_stretch")))
    lead = last.join(onward.where("_next IS NOT NULL"), at).drop("_stretch").withColumnRenamed("_next", "_stretch")
    between = meet(inside.where("_kind = 1").select(*rows.columns).unionByName(lead.select(*rows.columns)), False)
    pairs = inside.where("_kind = 0").unionByName(between).select(
        F.col("_camera").alias(camera), F.col("_frame").alias(frame), F.col("_prev").alias("prev_id"), F.col("_id").alias("id"), F.col("_iou").alias("iou"))
    return mutual_best(pairs, "prev_id", "id", "iou").select(camera, frame, "prev_id", "id", "iou")


def _meeting(max_cost: float, ends: bool):
    """Pairs of boxes of consecutive frames (kind 0) among a group's rows and, with ``ends``, the rows of its first (1) and last frame (2)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["_frame"].to_numpy(), kind="stable")))
        frame = table["_frame"].to_numpy()
        x1, y1, x2, y2 = (table[f"_{e}"].to_numpy() for e in EDGES)
        area, n = (x2 - x1) * (y2 - y1), len(frame)
        starts = np.append(np.flatnonzero(np.append([True], frame[1:] != frame[:-1])), n)
        # For every row behind the first frame, where the frame before it begins and how many rows it has.
        before = np.repeat(np.arange(len(starts) - 2), np.diff(starts)[1:])
        begin, many = starts[before], np.diff(starts)[before]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        sums, row = np.cumsum(many), 0
        while row < len(many):
            until = max(row + 1, int(np.searchsorted(sums, (sums[row - 1] if row else 0) + MEASURED, "right")))
            counts = many[row:until]
            b = np.repeat(np.arange(row, until) + starts[1], counts)
            a = np.repeat(begin[row:until] - np.cumsum(counts) + counts, counts) + np.arange(len(b))
            w = np.maximum(0.0, np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b]))
            h = np.maximum(0.0, np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]))
            shared = w * h
            iou = shared / np.maximum(G.UNION_FLOOR, area[a] + area[b] - shared)
            ok = (shared > 0) & (1.0 - iou <= max_cost)
            found.append((a[ok], b[ok], iou[ok]))
            row = until
        a, b, iou = (np.concatenate(f) for f in zip(*found))
        parts = [_shown(table.take(pa.array(b)), 0, table["_id"].take(pa.array(a)), pa.array(iou))]
        if ends:
            parts += [_shown(t, k, pa.nulls(len(t), table.schema.field("_id").type), pa.nulls(len(t), pa.float64()))
                      for k, t in ((1, table.slice(0, starts[1])), (2, table.slice(starts[-2])))]
        return pa.concat_tables(parts)

    return run


def _shown(rows: pa.Table, kind: int, prev, iou) -> pa.Table:
    out = rows.append_column("_prev", prev).append_column("_iou", iou)
    return out.add_column(0, "_kind", pa.array(np.full(len(rows), kind, np.int32)))


def associate_two_stage(boxes: DataFrame, camera: str, frame: str, id_col: str, box: str, score: str,
                        high: float = 0.5, low: float = 0.1, first_cost: float = 0.8,
                        second_cost: float = 0.9) -> DataFrame:
    """Confident boxes are linked first, faint ones then compete for the boxes left over."""
    sure = boxes.where(F.col(score) >= high)
    faint = boxes.where((F.col(score) < high) & (F.col(score) >= low))
    # Steps and first links are named twice: written once, so the boxes are not read and paired again.
    steps = cut_lineage(previous_frame(boxes.where(F.col(score) >= low), camera, frame))

    def link(current: DataFrame, earlier: DataFrame, cost: float) -> DataFrame:
        now = current.join(steps, [camera, frame]).where(F.col("prev_frame").isNotNull()).select(
            camera, "prev_frame", F.col(frame).alias("frame_now"), F.col(id_col).alias("id"),
            F.col(box).alias("_b"))
        then = earlier.select(camera, F.col(frame).alias("prev_frame"), F.col(id_col).alias("prev_id"),
                              F.col(box).alias("_a"))
        pairs = (overlapping_boxes(then, now, [camera, "prev_frame"], "_a", "_b")
                 .withColumn("iou", G.iou(F.col("_a"), F.col("_b"))).where(1.0 - F.col("iou") <= cost))
        return mutual_best(pairs, "prev_id", "id", "iou").select(
            camera, F.col("frame_now").alias(frame), "prev_id", "id", "iou")

    first = cut_lineage(link(sure, boxes.where(F.col(score) >= low), first_cost)).withColumn("stage", F.lit("high"))
    free = boxes.where(F.col(score) >= low).join(
        first.select(F.col("prev_id").alias(id_col)), id_col, "left_anti")
    second = link(faint, free, second_cost).withColumn("stage", F.lit("low"))
    return first.unionByName(second)


def associate_by_appearance(crops: DataFrame, camera: str, frame: str, id_col: str, vector: str,
                            max_distance: float = 0.4) -> DataFrame:
    """Link crops of consecutive frames by cosine distance; mutual best matches.

    Joined on (camera, frame), so a pair costs nothing beyond the crops of two adjacent frames.
    """
    steps = previous_frame(crops, camera, frame)
    now = crops.join(steps, [camera, frame]).where(F.col("prev_frame").isNotNull()).select(
        camera, "prev_frame", F.col(frame).alias("frame_now"), F.col(id_col).alias("id"),
        F.col(vector).alias("_b"))
    then = crops.select(camera, F.col(frame).alias("prev_frame"), F.col(id_col).alias("prev_id"),
                        F.col(vector).alias("_a"))
    pairs = (now.join(then, [camera, "prev_frame"])
             .withColumn("similarity", V.cosine(F.col("_a"), F.col("_b")))
             .where(1.0 - F.col("similarity") <= max_distance))
    return mutual_best(pairs, "prev_id", "id", "similarity").select(
        camera, F.col("frame_now").alias(frame), "prev_id", "id", "similarity")


def label_detections(tracked: DataFrame, detections: DataFrame, keys: Sequence[str], track: str,
                     id_col: str, track_box: str, box: str, floor: float = 0.7) -> DataFrame:
    """Give each tracked box's id to the detection it overlaps best, at IoU ``floor`` or more."""
    pairs = (overlapping_boxes(tracked.select(*keys, track, track_box),
                               detections.select(*keys, id_col, box), keys, track_box, box)
             .withColumn("iou", G.iou(F.col(track_box), F.col(box))))
    best = pairs.groupBy(*keys, track).agg(
        F.max_by(F.struct(id_col, "iou"), F.struct(F.col("iou"), -F.col(id_col))).alias("_m"))
    return best.select(*keys, track, f"_m.{id_col}", "_m.iou").where(F.col("iou") >= floor)


def lifecycle(rows: DataFrame, keys: Sequence[str], ts_ms: str, frame_gap_ms: int, min_hits: int = 2,
              max_lost_ms: int = 30_000, chunk_ms: int = 3_600_000) -> DataFrame:
    """State of a track at each of its sightings, and how it came back.

    A gap longer than ``frame_gap_ms`` means missed frames. A tentative track is then gone and the
    sighting starts a new life; a confirmed one was lost and recovers if seen again within
    ``max_lost_ms``. ``min_hits`` sightings without a miss confirm. Adds ``life_start``, ``state``
    and ``recovered``.
    """
    chunk = ordered.time_chunk(ts_ms, chunk_ms)
    h = with_history(rows, keys, [ts_ms], [ts_ms], max(min_hits, 2), chunk, "_h")
    h = h.withColumn("gap_ms", F.col(ts_ms) - back("_h", 1)[ts_ms])
    streak = F.size(F.col("_h")) >= min_hits
    for i in range(1, min_hits):
        streak = streak & ((back("_h", i - 1)[ts_ms] - back("_h", i)[ts_ms]) <= frame_gap_ms)
    apart = F.col("gap_ms").isNull() | (F.col("gap_ms") > max_lost_ms)
    missed = F.coalesce(F.col("gap_ms") > frame_gap_ms, F.lit(False))
    # Each step below names its input twice; a written table keeps that from multiplying the scans.
    h = cut_lineage(h.withColumn("_confirms", F.coalesce(streak, F.lit(False))).drop("_h"))
    h = cut_lineage(forward_fill(h, keys, [ts_ms], F.when(apart, F.col(ts_ms)), chunk, "_epoch"))
    epoch = list(keys) + ["_epoch"]
    first = h.groupBy(*epoch).agg(F.min(F.when(F.col("_confirms"), F.col(ts_ms))).alias("_first"))
    h = h.join(first, epoch, "left")
    confirmed = F.coalesce(F.col(ts_ms) >= F.col("_first"), F.lit(False))
    h = h.withColumn("state", F.when(confirmed, F.lit("confirmed")).otherwise(F.lit("tentative")))
    h = h.withColumn("recovered", confirmed & missed & ~apart)
    restart = apart | (missed & (F.col("state") == "tentative"))
    h = forward_fill(h, keys, [ts_ms], F.when(restart, F.col(ts_ms)), chunk, "life_start")
    return h.drop("_confirms", "_epoch", "_first")


def lifecycle_end(states: DataFrame, keys: Sequence[str], ts_ms: str, as_of_ms: int,
                  frame_gap_ms: int, max_lost_ms: int = 30_000) -> DataFrame:
    """Where each track stands at ``as_of_ms``: its last state, lost or deleted by silence."""
    last = states.groupBy(*keys).agg(F.max_by("state", ts_ms).alias("last_state"),
                                     F.max(ts_ms).alias("last_seen"))
    silent = F.lit(as_of_ms) - F.col("last_seen")
    return last.withColumn(
        "status",
        F.when(silent <= frame_gap_ms, F.col("last_state"))
        .when(F.col("last_state") == "tentative", F.lit("deleted"))
        .when(silent <= max_lost_ms, F.lit("lost")).otherwise(F.lit("deleted")))


def track_summary(rows: DataFrame, keys: Sequence[str], ts_ms: str, score: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"), F.avg(score).alias("avg_confidence"),
        F.min(ts_ms).alias("first_seen"), F.max(ts_ms).alias("last_seen"))


def motion(rows: DataFrame, keys: Sequence[str], ts_ms: str, x: str, y: str, steps: int = 5,
           chunk_ms: int = 3_600_000, order: Sequence[str] | None = None) -> DataFrame:
    """Adds history-based motion: previous centre, vector over ``steps`` rows, acceleration,
    stationarity over ten rows. ``path`` holds the last rows as structs x, y, t."""
    order = list(order or [ts_ms])
    named = rows.withColumn("_p", F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(ts_ms).alias("t")))
    h = with_history(named, keys, order, ["_p"], max(10, steps), ordered.time_chunk(ts_ms, chunk_ms), "_hist")
    h = h.withColumn("path", F.transform("_hist", lambda s: s["_p"])).drop("_hist", "_p")
    p1, p2, pn = back("path", 1), back("path", 2), back("path", steps - 1)
    ax = F.col(x) - 2 * p1["x"] + p2["x"]
    ay = F.col(y) - 2 * p1["y"] + p2["y"]
    return (h.withColumn("prev", p1)
            .withColumn("move_x", F.col(x) - pn["x"]).withColumn("move_y", F.col(y) - pn["y"])
            .withColumn("acceleration", F.sqrt(ax * ax + ay * ay)))


def stationary(path: Column, max_std: float = 4.0, rows: int = 10, at_least: int = 3) -> Column:
    """Population deviation of the last ``rows`` centres below ``max_std`` on both axes."""
    recent = F.slice(path, F.greatest(F.size(path) - (rows - 1), F.lit(1)), rows)

    def deviation(axis: str) -> Column:
        vals = F.transform(recent, lambda p: p[axis].cast("double"))
        n = F.size(recent)
        mean = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / n
        squares = V.with_each(vals, mean, lambda v, m: (v - m) * (v - m))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, v: a + v) / n)

    return (F.size(path) >= at_least) & (deviation("x") < max_std) & (deviation("y") < max_std)


def build_tracks(boxes: DataFrame, camera: str, frame: str, id_col: str, box: str, ts_ms: str,
                 max_cost: float = 0.8, max_lost_ms: int = 30_000) -> DataFrame:
    """Track of every box: ``id_col, track_id``; a track is named by its smallest box id.

    Boxes of consecutive frames are linked into runs. The end of a run is then linked to the start
    of a later one of the same camera when their boxes overlap enough within ``max_lost_ms``, which
    bridges occlusions. Both links are mutual best matches.
    """
    links = cut_lineage(associate_by_overlap(boxes, camera, frame, id_col, box, max_cost).select(
        F.col("prev_id").alias("a"), F.col("id").alias("b"), F.col(camera).alias("_camera"), F.floor(F.col(frame) / NEAR_FRAMES).alias("_near"))
        .where("a IS NOT NULL AND b IS NOT NULL"))
    runs = cut_lineage(connected_components(_ends_of(links), links, ["_camera", "_near"]))
    # A box has one link at most on either side, so a run is a path: its end has none onward, its start none before.
    named = (boxes.where(F.col(id_col).isNotNull()).select(id_col, camera, box, ts_ms).dropDuplicates([id_col])
             .join(runs.withColumnRenamed("node", id_col), id_col, "left")
             .join(links.select(F.col("a").alias(id_col), F.lit(True).alias("_onward")), id_col, "left")
             .join(links.select(F.col("b").alias(id_col), F.lit(True).alias("_before")), id_col, "left")
             .withColumn("component", F.coalesce("component", id_col)))
    last = named.where("_onward IS NULL").select(camera, F.col("component").alias("a"), F.col(box).alias("_a"), F.col(ts_ms).alias("_ta"))
    first = named.where("_before IS NULL").select(camera, F.col("component").alias("b"), F.col(box).alias("_b"), F.col(ts_ms).alias("_tb"))
    width = SLOT_BRIDGES * max_lost_ms
    last = last.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_ta") / width), F.floor((F.col("_ta") + max_lost_ms) / width))))
    first = first.withColumn("_slot", F.floor(F.col("_tb") / width))
    gap = F.col("_tb") - F.col("_ta")
    bridges = (overlapping_boxes(last, first, [camera, "_slot"], "_a", "_b", MEET_PX)
               .withColumn("iou", G.iou(F.col("_a"), F.col("_b")))
               .where((gap > 0) & (gap <= max_lost_ms) & (1.0 - F.col("iou") <= max_cost)))
    found = bridges.select("a", "b", "iou", F.col(camera).alias("_camera"), F.floor(F.col("_slot") / NEAR_SLOTS).alias("_near"))
    bridged = cut_lineage(mutual_best(found, "a", "b", "iou").select("a", "b", "_camera", "_near"))
    joined = connected_components(_ends_of(bridged), bridged, ["_camera", "_near"])
    names = joined.select(F.col("node").alias("component"), F.col("component").alias("track_id"))
    # A box that comes n times counts n times on either side, as its rows and as nodes.
    ids = boxes.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    return (ids.join(runs.withColumnRenamed("node", id_col), id_col, "left")
            .withColumn("component", F.coalesce("component", id_col)).join(names, "component", "left")
            .withColumn("_of", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") * F.col("_n"))))
            .select(id_col, F.coalesce("track_id", "component").alias("track_id")))


def _ends_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
