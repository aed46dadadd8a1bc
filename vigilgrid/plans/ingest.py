"""Segments, request limits and lockouts over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilgrid.operators.greedy import burst_then_pause, chain_anchors, fixed_window
from vigilgrid.operators.ordered import forward_fill, time_chunk

HOUR_MS = 3_600_000


def segments(frames: DataFrame, ts: str, length_s: int = 30, overlap_s: int = 2, at_least: int = 2) -> DataFrame:
    """Overlapping segments per camera with start, end, frame count and measured rate.

    Segments start at multiples of length - overlap on the clock rather than at a camera's first
    frame, so any two runs and any two cameras cut alike. Short tails of one frame are dropped.
    """
    step = length_s - overlap_s
    w = F.window(ts, f"{length_s} seconds", f"{step} seconds")
    out = frames.groupBy("camera_id", w.alias("w")).agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("frames"))
    span = (F.col("last_ms") - F.col("first_ms")) / 1000.0
    return out.where(F.col("frames") >= at_least).select(
        "camera_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "first_ms", "last_ms", "frames",
        F.when(span > 0, (F.col("frames") - 1) / span).alias("fps"))


def rate_windows(requests: DataFrame, keys: list[str], ts_ms: str, allowed: int = 100, width_ms: int = HOUR_MS,
                 chunk_ms: int = 6 * HOUR_MS) -> DataFrame:
    """Requests per window opened by the first request after the last one expired, and how many
    went beyond ``allowed``."""
    chunk_ms = max(chunk_ms, width_ms)
    opened = chain_anchors(requests, keys, ts_ms, fixed_window(width_ms), width_ms, chunk_ms=chunk_ms).select(
        *keys, ts_ms, F.col(ts_ms).alias("_opened"))
    counts = requests.groupBy(*keys, ts_ms).agg(F.count(F.lit(1)).alias("_n"))
    marked = counts.join(opened, keys + [ts_ms], "left")
    filled = forward_fill(marked, keys, [ts_ms], F.col("_opened"), time_chunk(ts_ms, chunk_ms), "opened_ms")
    return filled.groupBy(*keys, "opened_ms").agg(F.sum("_n").alias("requests")).withColumn(
        "refused", F.greatest(F.col("requests") - allowed, F.lit(0)))


def lockouts(failures: DataFrame, keys: list[str], ts_ms: str, burst: int = 5, within_ms: int = 600_000,
             pause_ms: int = 900_000, chunk_ms: int = 6 * HOUR_MS) -> DataFrame:
    """Moments at which ``burst`` failures inside ``within_ms`` locked an account for ``pause_ms``.

    Failures during a lock do not count, and the counter starts afresh after it.
    """
    longest = within_ms + pause_ms
    anchors = chain_anchors(failures, keys, ts_ms, burst_then_pause(burst, within_ms, pause_ms), longest,
                            lookahead_ms=within_ms, chunk_ms=max(chunk_ms, longest))
    opened = anchors.where(F.col("label") == 1).select(*keys, F.col(ts_ms).alias("opened_ms"))
    near = failures.select(*keys, F.col(ts_ms).alias("_t")).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_n"))
    # A lock's failures lie in the opening chunk of within_ms or the next, so this stays an equi join.
    a = opened.withColumn("_c", F.explode(F.sequence(F.floor(F.col("opened_ms") / within_ms), F.floor(F.col("opened_ms") / within_ms) + 1)))
    b = near.withColumn("_c", F.floor(F.col("_t") / within_ms))
    inside = a.join(b, keys + ["_c"]).where((F.col("_t") >= F.col("opened_ms")) & (F.col("_t") < F.col("opened_ms") + within_ms))
    from pyspark.sql import Window
    run = Window.partitionBy(*keys, "opened_ms").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("_sum", F.sum("_n").over(run)).where(F.col("_sum") >= burst)
    return reached.groupBy(*keys, "opened_ms").agg(F.min("_t").alias("locked_ms")).withColumn(
        "until_ms", F.col("locked_ms") + pause_ms)
