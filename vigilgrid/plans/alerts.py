"""Rule-based alerts over tracks.

A detector takes tracks and rules and returns candidate alerts; ``suppress`` then drops repeats.
Tracks: camera_id, track_id, class_id, ts_ms, x1, y1, x2, y2; rows of one camera and time form a frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.functions import geometry as G
from vigilgrid.functions.text import drop_keys
from vigilgrid.operators import crowds, spatial as S, tracks as T
from vigilgrid.operators.greedy import chain_anchors, fixed_gap
from vigilgrid.operators.ordered import islands, time_chunk
from vigilgrid.session import cut_lineage

PERSON = 0
# Bag classes with their names, words that mark private metadata, dwell limits in seconds.
BAGS = {26: "backpack", 30: "handbag", 32: "suitcase"}
PRIVATE_WORDS = ["name", "identity", "biometric", "face_embedding", "person_name", "social_security",
                 "driver_license", "gender", "age"]
DWELL_LIMITS = {"person": 300.0, "vehicle": 600.0, "object": 450.0}
VEHICLES = ["car", "truck", "motorcycle", "bus", "bicycle", "vehicle"]

WINDOW_MS = 30_000
CHUNK_MS = 3_600_000
KEYS = ["camera_id", "event_type", "zone_id"]
ALERT = ["camera_id", "event_type", "severity", "ts_ms", "zone_id", "metadata"]


def suppress(candidates: DataFrame, window_ms: int = WINDOW_MS, tie: list[str] = ("order",),
             chunk_ms: int = 6 * CHUNK_MS) -> DataFrame:
    """Drop an alert of the same camera, type and zone within ``window_ms`` (inclusive) of the last
    one let through. Candidates of the same moment count in the order of ``tie``."""
    c = candidates.withColumn("zone_id", F.coalesce("zone_id", F.lit("")))
    others = [n for n in c.columns if n not in KEYS and n != "ts_ms"]
    # The candidates come out of joins and windows; one written copy spares computing them again.
    first = cut_lineage(c.groupBy(*KEYS, "ts_ms").agg(F.min_by(F.struct(*others), F.struct(*tie)).alias("_c")))
    anchors = chain_anchors(first, KEYS, "ts_ms", fixed_gap(window_ms), window_ms + 1, chunk_ms=max(chunk_ms, window_ms + 1))
    kept = first.join(anchors.drop("label"), KEYS + ["ts_ms"], "left_semi")
    return kept.select(*KEYS, "ts_ms", *[f"_c.{n}" for n in others]).withColumn("zone_id", F.nullif("zone_id", F.lit("")))


def _centres(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("cx", (F.col("x1") + F.col("x2")) / 2.0).withColumn("cy", (F.col("y1") + F.col("y2")) / 2.0)


def _candidate(df: DataFrame, event_type: str, severity: str, zone: Column, order: Column, **metadata: Column) -> DataFrame:
    return df.select("camera_id", F.lit(event_type).alias("event_type"), F.lit(severity).alias("severity"), "ts_ms",
                     zone.cast("string").alias("zone_id"), order.alias("order"),
                     F.to_json(F.struct(*[v.alias(k) for k, v in metadata.items()])).alias("metadata"))


def loitering(tracks: DataFrame, rules: dict) -> DataFrame:
    """Stay inside a configured zone for at least the dwell threshold."""
    limit = rules.get("dwell_threshold_ms", 30_000)
    inside = S.configured_zones(_centres(tracks), rules.get("zones", {}), "cx", "cy")
    since = islands(inside, ["camera_id", "track_id", "zone_id"], ["ts_ms"], F.col("inside"), "ts_ms",
                    time_chunk("ts_ms", rules.get("chunk_ms", CHUNK_MS)), "entered")
    dwell = F.col("ts_ms") - F.col("entered")
    return _candidate(since.where(dwell >= limit), "loitering", rules.get("severity", "MEDIUM"), F.col("zone_id"), F.struct("track_id"),
                      track_id=F.col("track_id"), dwell_time_seconds=dwell / 1000.0, class_label=F.col("class_id"),
                      bounding_box=F.array("x1", "y1", "x2", "y2"))


def perimeter(tracks: DataFrame, rules: dict) -> DataFrame:
    """Crossing of a tripwire, or stepping from outside a zone to inside it."""
    moved = T.motion(_centres(tracks), ["camera_id", "track_id"], "ts_ms", "cx", "cy", 2, rules.get("chunk_ms", CHUNK_MS))
    moved = moved.where(F.col("prev").isNotNull())
    severity = rules.get("severity", "CRITICAL")
    parts = []
    if rules.get("lines"):
        crossed = S.crossings(moved, rules["lines"], F.col("prev"), "cx", "cy")
        parts.append(_candidate(crossed, "perimeter_breach", severity, F.col("line_id"), F.struct("track_id", F.lit(0)),
                                breach_type=F.lit("tripwire_crossing"), track_id=F.col("track_id"), class_label=F.col("class_id"),
                                crossing_segment=F.array(F.array("prev.x", "prev.y"), F.array("cx", "cy"))))
    if rules.get("zones"):
        tests = [F.struct(F.lit(z).alias("zone"), (~G.within_polygon(F.col("prev.x"), F.col("prev.y"), ring)
                                                   & G.within_polygon(F.col("cx"), F.col("cy"), ring)).alias("hit"))
                 for z, ring in sorted(rules["zones"].items()) if len(ring) >= 3]
        entered = moved.withColumn("_z", F.explode(F.filter(F.array(*tests), lambda z: z["hit"])))
        parts.append(_candidate(entered, "perimeter_breach", severity, F.col("_z.zone"), F.struct("track_id", F.lit(1)),
                                breach_type=F.lit("zone_entry"), track_id=F.col("track_id"), class_label=F.col("class_id"),
                                bounding_box=F.array("x1", "y1", "x2", "y2")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wrong_direction(tracks: DataFrame, rules: dict) -> DataFrame:
    """Motion over the last rows pointing against the allowed direction."""
    n = rules.get("history_frames", 5)
    ax, ay = rules.get("allowed_direction", (1.0, 0.0))
    length = math.hypot(ax, ay)
    if length == 0:
        return _candidate(tracks.limit(0), "wrong_direction", "MEDIUM", F.lit(None), F.struct("track_id"), track_id=F.col("track_id"))
    limit = math.cos(math.radians(180.0 - rules.get("angle_threshold", 90.0)))
    m = T.motion(_centres(tracks), ["camera_id", "track_id"], "ts_ms", "cx", "cy", n, rules.get("chunk_ms", CHUNK_MS))
    pace = F.sqrt(F.col("move_x") ** 2 + F.col("move_y") ** 2)
    dot = (F.col("move_x") * ax + F.col("move_y") * ay) / (pace * length)
    return _candidate(m.where((pace >= 10.0) & (dot < limit)), "wrong_direction", rules.get("severity", "MEDIUM"),
                      F.lit(rules.get("zone_id")), F.struct("track_id"), track_id=F.col("track_id"), class_label=F.col("class_id"),
                      dot_product=dot, motion_vector=F.array(F.col("move_x") / pace, F.col("move_y") / pace))


def crowd_groups(tracks: DataFrame, rules: dict) -> DataFrame:
    """Members of crowds per frame; ``component`` names the group by its first member."""
    people = _centres(tracks.where(F.col("class_id") == PERSON)).withColumn(
        "node", F.concat_ws(":", "camera_id", "ts_ms", F.lpad(F.col("track_id").cast("string"), 19, "0")))
    return crowds.clusters(people, ["camera_id", "ts_ms"], "node", "cx", "cy", rules.get("density_threshold", 150.0),
                           rules.get("count_threshold", 10))


def crowd(tracks: DataFrame, rules: dict, frame_w: int = 1920, frame_h: int = 1080,
          window_ms: int = WINDOW_MS) -> DataFrame:
    """Crowd alerts, already suppressed: statistics and density only for those let through."""
    members = crowd_groups(tracks, rules)
    stats = crowds.cluster_stats(members, ["camera_id", "ts_ms"], "track_id", "cx", "cy")
    alerts = suppress(stats.select(
        "camera_id", F.lit("crowd_gathering").alias("event_type"), F.lit(rules.get("severity", "HIGH")).alias("severity"), "ts_ms",
        F.lit(rules.get("zone_id")).cast("string").alias("zone_id"), F.col("component").alias("order"), "people_count",
        "centroid_x", "centroid_y", "min_x", "min_y", "max_x", "max_y"), window_ms)
    alerts = alerts.withColumnRenamed("order", "component")
    in_alert = members.join(alerts.select("component"), "component", "left_semi")
    peak = crowds.density_peak(in_alert, ["component"], "cx", "cy", frame_w, frame_h)
    ids = crowds.member_lists(in_alert, alerts, ["component"], "track_id")
    full = alerts.join(peak, "component").join(ids, "component")
    return full.select("camera_id", "event_type", "severity", "ts_ms", "zone_id", F.to_json(F.struct(
        "people_count", F.array("centroid_x", "centroid_y").alias("centroid"),
        F.array("min_x", "min_y", "max_x", "max_y").alias("bounding_box"), "max_density", "track_ids")).alias("metadata"))


def abandoned(tracks: DataFrame, rules: dict) -> DataFrame:
    """Stationary bag with nobody near for at least the time threshold."""
    radius = rules.get("proximity_threshold", 120.0)
    bags = T.motion(_centres(tracks.where(F.col("class_id").isin(*BAGS))), ["camera_id", "track_id"], "ts_ms", "cx", "cy",
                    2, rules.get("chunk_ms", CHUNK_MS))
    bags = bags.withColumn("still", T.stationary(F.col("path"), rules.get("stationary_std_threshold", 4.0))).drop("path")
    people = _centres(tracks.where(F.col("class_id") == PERSON)).select(
        "camera_id", "ts_ms", F.col("cx").alias("px"), F.col("cy").alias("py"))
    near = S.near_pairs(bags.where("still").select("camera_id", "ts_ms", "track_id", F.col("cx").alias("bx"), F.col("cy").alias("by")),
                        people, ["camera_id", "ts_ms"], radius, ("bx", "by"), ("px", "py"))
    attended = near.select("camera_id", "ts_ms", "track_id").distinct().withColumn("attended", F.lit(True))
    flagged = bags.join(attended, ["camera_id", "ts_ms", "track_id"], "left")
    alone = F.col("still") & F.col("attended").isNull()
    since = islands(flagged, ["camera_id", "track_id"], ["ts_ms"], alone, "ts_ms", time_chunk("ts_ms", rules.get("chunk_ms", CHUNK_MS)), "alone_since")
    span = F.col("ts_ms") - F.col("alone_since")
    item = F.lit("luggage")
    for cid, name in BAGS.items():
        item = F.when(F.col("class_id") == cid, name).otherwise(item)
    return _candidate(since.where(span >= rules.get("abandoned_time_threshold_ms", 30_000)), "abandoned_object",
                      rules.get("severity", "CRITICAL"), F.lit(rules.get("zone_id")), F.struct("track_id"), item_type=item,
                      object_track_id=F.col("track_id"), abandoned_duration_seconds=span / 1000.0,
                      bounding_box=F.array("x1", "y1", "x2", "y2"))


def fight(tracks: DataFrame, rules: dict, every: bool = True) -> DataFrame:
    """Overlapping pair of people who both change speed abruptly.

    ``every`` lists all pairs of a moment; only the first of them can pass ``suppress``.
    """
    jolt = rules.get("acceleration_threshold", 30.0)
    m = T.motion(_centres(tracks.where(F.col("class_id") == PERSON)), ["camera_id", "track_id"], "ts_ms", "cx", "cy", 3,
                 rules.get("chunk_ms", CHUNK_MS))
    restless = m.where(F.col("acceleration") > jolt).withColumn("box", G.box("x1", "y1", "x2", "y2"))
    limit = rules.get("overlap_threshold", 0.35)
    if every:
        pairs = S.overlap_pairs(restless, ["camera_id", "ts_ms"], "track_id", "box", G.overlap_of_smaller, ["acceleration"]).where(F.col("overlap") >= limit)
    else:
        pairs = S.first_overlaps(restless, ["camera_id", "ts_ms"], "track_id", "box", limit, ["acceleration"])
    return _candidate(pairs, "fight", rules.get("severity", "CRITICAL"),
                      F.lit(rules.get("zone_id")), F.struct("a", "b"), overlap_ratio=F.col("overlap"), track_ids=F.array("a", "b"),
                      accelerations=F.array("acceleration_a", "acceleration_b"))


Detector = Callable[[DataFrame, dict], DataFrame]
DETECTORS: dict[str, Detector] = {"loitering": loitering, "perimeter": perimeter, "wrong_direction": wrong_direction,
                                  "abandoned": abandoned, "fight": partial(fight, every=False)}


def register(name: str, detector: Detector) -> None:
    """Add a detector: a function of tracks and rules returning candidate alerts with ``order``."""
    DETECTORS[name] = detector


def detect(tracks: DataFrame, configured: dict[str, dict], window_ms: int = WINDOW_MS) -> DataFrame:
    """Alerts of every configured detector, repeats dropped per detector, crowds included."""
    out = None
    for name, rules in configured.items():
        if name == "crowd":
            found = crowd(tracks, rules, window_ms=window_ms)
        else:
            found = suppress(DETECTORS[name](tracks, rules), window_ms).drop("order")
        out = found if out is None else out.unionByName(found)
    return with_event_id(out)


def with_event_id(alerts: DataFrame) -> DataFrame:
    """A repeatable id, so that a retried job publishes the same alert under the same id."""
    return alerts.withColumn("event_id", F.md5(F.concat_ws("|", "camera_id", "event_type", F.coalesce("zone_id", F.lit("")), "ts_ms")))


def suspicious_dwell(tracks: DataFrame, label: str = "class_label", limits: dict[str, float] = DWELL_LIMITS) -> DataFrame:
    """Tracks seen for longer than their category's limit in seconds."""
    per = tracks.groupBy("camera_id", "track_id", label).agg(F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))
    limit = (F.when(F.col(label) == "person", limits["person"]).when(F.col(label).isin(*VEHICLES), limits["vehicle"])
             .otherwise(limits["object"]))
    return per.withColumn("dwell_s", (F.col("last_seen") - F.col("first_seen")) / 1000.0).withColumn("limit_s", limit).withColumn(
        "is_suspicious", F.col("dwell_s") > F.col("limit_s"))


def camera_status(reports: DataFrame, as_of_ms: int, fps: str = "fps", target: str = "target_fps", errors: str = "errors",
                  stale_ms: int = 30_000) -> DataFrame:
    """Offline by silence, else critical or degraded by error count or frame rate.

    ``reports``: camera_id, ts_ms, fps, target_fps, errors; the latest report of a camera counts.
    """
    last = reports.groupBy("camera_id").agg(F.max_by(F.struct("ts_ms", fps, target, errors), "ts_ms").alias("r")).select("camera_id", "r.*")
    ratio = F.when((F.col(target) > 0) & (F.col(fps) > 0), F.col(fps) / F.col(target))
    status = (F.when(F.lit(as_of_ms) - F.col("ts_ms") > stale_ms, "offline").when(F.col(errors) >= 20, "critical")
              .when(F.col(errors) >= 5, "degraded").when(ratio < 0.3, "critical").when(ratio < 0.7, "degraded").otherwise("healthy"))
    return last.withColumn("status", status)


def publishable(alerts: DataFrame) -> DataFrame:
    """Alerts as JSON payloads, private keys removed from the metadata at any depth."""
    clean = alerts.withColumn("metadata", drop_keys(PRIVATE_WORDS)("metadata"))
    head = ["event_id", "camera_id", "event_type", "severity", "ts_ms", "zone_id"]
    body = F.to_json(F.struct(*[F.col(c).alias("timestamp_ms" if c == "ts_ms" else c) for c in head]), {"ignoreNullFields": "false"})
    payload = F.concat(F.left(body, F.length(body) - 1), F.lit(', "metadata": '), F.coalesce("metadata", F.lit("{}")), F.lit("}"))
    return clean.select("event_id", payload.alias("payload"))
