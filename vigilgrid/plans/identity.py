"""Identities across cameras: matching, assignment, paths and dwell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilgrid.functions import vectors as V
from vigilgrid.operators import joins as J
from vigilgrid.operators.graph import connected_components
from vigilgrid.operators.nearest import nearest
from vigilgrid.session import cut_lineage

# Which labels count as vehicles and how alike a match must be.
VEHICLE_LABELS = ["car", "truck", "bus", "motorcycle", "suv", "van"]
MATCH_AT = {"person": 0.82, "vehicle": 0.75}


def object_type(label: Column) -> Column:
    """Gallery type of a class label; null for things that have no identity."""
    lowered = F.lower(label)
    return F.when(lowered == "person", "person").when(lowered.isin(*VEHICLE_LABELS), "vehicle")


def match_gallery(sightings: DataFrame, gallery: DataFrame, thresholds: dict[str, float] = MATCH_AT) -> DataFrame:
    """Best gallery identity of the same organisation and type for each sighting.

    ``sightings``: det_id, org_id, object_type, embedding; ``gallery``: gallery_id, org_id,
    object_type, embedding. Below the type's threshold a sighting has no match and no row.
    """
    groups = ["org_id", "object_type"]
    best = nearest(sightings.where(F.col("object_type").isNotNull()), gallery, 1, groups, "det_id", "gallery_id",
                   threshold=min(thresholds.values()))
    limit = F.lit(None).cast("double")
    for kind, value in thresholds.items():
        limit = F.when(F.col("object_type") == kind, F.lit(value)).otherwise(limit)
    return best.join(sightings.select("det_id", "object_type"), "det_id").where(
        F.col("similarity") >= limit).select("det_id", "gallery_id", "similarity")


def search_by_embedding(probe: DataFrame, gallery: DataFrame, sightings: DataFrame, threshold: float = 0.80,
                        profiles: int = 10, limit: int = 50) -> DataFrame:
    """Sightings of the profiles most like the probe, newest kept, best first; straight to the
    sightings' own vectors when no profile is close enough.

    ``probe``: one row probe_id, embedding. ``gallery`` and ``sightings`` are already restricted to
    the type, cameras and time wanted. Sightings: det_id, gallery_id, seen_ms, embedding.
    """
    found = nearest(probe, gallery, profiles, (), "probe_id", "gallery_id", threshold=threshold)
    scores = found.select("gallery_id", F.col("similarity").alias("score"))
    traced = (sightings.join(scores, "gallery_id").orderBy(F.desc("seen_ms"), "det_id").limit(limit)
              .select("det_id", "gallery_id", "seen_ms", "score", F.lit("reid_gallery").alias("search_source")))
    near = nearest(probe, sightings, limit, (), "probe_id", "det_id", threshold=threshold)
    direct = (near.select("det_id", F.col("similarity").alias("score")).join(sightings, "det_id")
              .select("det_id", "gallery_id", "seen_ms", "score", F.lit("reid_direct").alias("search_source")))
    return J.prefer(traced, direct).orderBy(F.desc("score"), "det_id")


def camera_legs(sightings: DataFrame) -> DataFrame:
    """One row per identity and camera: entry, exit, dwell and visit order.

    Entry is the first segment start plus the smallest offset, exit the last start plus the largest.
    Sightings: gallery_id, camera_id, segment_start, timestamp_ms.
    """
    start = F.unix_millis(F.col("segment_start").cast("timestamp"))
    legs = sightings.where(F.col("gallery_id").isNotNull()).groupBy("gallery_id", "camera_id").agg(
        F.min(start).alias("first_seen"), F.max(start).alias("last_seen"),
        F.min("timestamp_ms").alias("min_ts"), F.max("timestamp_ms").alias("max_ts"))
    # Rows per identity are its cameras, so this window is small however often it was seen.
    order = Window.partitionBy("gallery_id").orderBy("first_seen", "min_ts", "camera_id")
    entry, leave = F.col("first_seen") + F.col("min_ts"), F.col("last_seen") + F.col("max_ts")
    return legs.select("gallery_id", "camera_id", (F.row_number().over(order) - 1).cast("long").alias("sequence_index"),
                       entry.alias("entry_ms"), leave.alias("exit_ms"),
                       F.greatest(F.lit(0), leave - entry).alias("dwell_time_ms"))


def dwell_by_camera(legs: DataFrame) -> DataFrame:
    return legs.groupBy("gallery_id", "camera_id").agg(F.sum("dwell_time_ms").alias("dwell_time_ms"))


def dwell_anomalies(legs: DataFrame, minutes: float = 5.0) -> DataFrame:
    return legs.where(F.col("dwell_time_ms") >= minutes * 60_000).withColumn(
        "dwell_time_minutes", F.round(F.col("dwell_time_ms") / 60_000.0, 2))


def followed_path(legs: DataFrame, cameras: Sequence) -> DataFrame:
    """Identities that visited ``cameras`` in that order, not necessarily one right after another.

    Each step is the earliest visit after the previous step, an aggregation per identity; fewer
    than two cameras match nobody.
    """
    if len(cameras) < 2:
        return legs.select("gallery_id").limit(0)
    at = legs.where(F.col("camera_id") == F.lit(cameras[0])).groupBy("gallery_id").agg(F.min("sequence_index").alias("at"))
    for camera in cameras[1:]:
        step = legs.where(F.col("camera_id") == F.lit(camera)).select("gallery_id", "sequence_index")
        at = step.join(at, "gallery_id").where(F.col("sequence_index") > F.col("at")).groupBy("gallery_id").agg(
            F.min("sequence_index").alias("at"))
    return at.select("gallery_id")


def newest_identity(gallery: DataFrame, kind: str) -> DataFrame:
    """Latest created profile of a type; ``car`` means vehicle."""
    kind = "vehicle" if kind == "car" else kind
    return gallery.where(F.col("object_type") == kind).orderBy(F.desc("created_at"), "gallery_id").limit(1)


def track_newest(gallery: DataFrame, sightings: DataFrame, kind: str, limit: int = 10) -> DataFrame:
    """Path of the newest identity of a type, in time order."""
    one = newest_identity(gallery, kind).select("gallery_id")
    return sightings.join(one, "gallery_id", "left_semi").orderBy("segment_start", "timestamp_ms", "det_id").limit(limit)


def assign_identities(sightings: DataFrame, gallery: DataFrame, thresholds: dict[str, float] = MATCH_AT) -> DataFrame:
    """Identity of every sighting of a batch: ``det_id, gallery_id, is_new``.

    Sightings are matched to the gallery as it stands. One left over joins its most alike earlier
    sighting of the rest when that is alike enough, else it mints an identity, named by the first
    sighting of the group. That is the one-at-a-time procedure with an identity represented by all
    its sightings instead of by a drifting average, whose result depends on arrival order.
    """
    matched = cut_lineage(match_gallery(sightings, gallery, thresholds)).select(
        "det_id", "gallery_id", F.lit(False).alias("is_new"))
    rest = sightings.where(F.col("object_type").isNotNull()).join(matched, "det_id", "left_anti")
    links = similar_pairs(rest, thresholds)
    groups = connected_components(rest.select(F.col("det_id").alias("node")), links)
    minted = groups.select(F.col("node").alias("det_id"), F.col("component").alias("gallery_id"), F.lit(True).alias("is_new"))
    return matched.unionByName(minted)


def similar_pairs(rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Link ``a, b`` from each row to its most alike earlier row at or above its type's threshold."""
    groups = ["org_id", "object_type"]
    near = nearest(rows.withColumnRenamed("det_id", "a"), rows.withColumnRenamed("det_id", "b"), 1, groups,
                   "a", "b", threshold=min(thresholds.values()), earlier_only=True)
    limit = F.lit(None).cast("double")
    for kind, value in thresholds.items():
        limit = F.when(F.col("object_type") == kind, F.lit(value)).otherwise(limit)
    return near.join(rows.select(F.col("det_id").alias("a"), "object_type"), "a").where(F.col("similarity") >= limit).select("a", "b")


def profile_updates(assigned: DataFrame, sightings: DataFrame) -> DataFrame:
    """First and last time and the cameras each identity was seen on in the batch.

    Sightings: det_id, camera_id, seen_ms. Cameras are few, so the set stays small.
    """
    return assigned.join(sightings.select("det_id", "camera_id", "seen_ms"), "det_id").groupBy("gallery_id", "is_new").agg(
        F.min("seen_ms").alias("first_seen_ms"), F.max("seen_ms").alias("last_seen_ms"),
        F.array_sort(F.collect_set("camera_id")).alias("cameras_seen"), F.count(F.lit(1)).alias("sightings"))


def zero_shot(rows: DataFrame, labels: DataFrame, id_col: str, vector: str = "embedding", scale: float = 100.0,
              multi_floor: float = 0.25) -> DataFrame:
    """Best label, its softmax confidence, and every label above ``multi_floor``, per row.

    ``labels`` (label, embedding) is the caller's short vocabulary; it is folded into the plan
    as one array, after a size check.
    """
    vocabulary = labels.select("label", F.transform(V.normalise(F.col("embedding")), lambda x: x).alias("v"))
    size = vocabulary.limit(MAX_VOCABULARY + 1).count()
    if size > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} labels; use nearest() with the labels as candidates")
    packed = vocabulary.agg(F.array_sort(F.collect_list(F.struct("label", "v"))).alias("_labels")).withColumn("_one", F.lit(1))
    sims = F.transform("_labels", lambda e: F.struct(V.dot(e["v"], F.col("_v")).alias("s"), e["label"].alias("label")))
    out = (rows.select(id_col, V.normalise(F.col(vector)).alias("_v")).withColumn("_one", F.lit(1))
           .join(F.broadcast(packed), "_one").select(id_col, sims.alias("_s")))
    best = F.array_max("_s")
    return out.select(id_col, best["label"].alias("label"), best["s"].alias("similarity"),
                      F.array_max(V.softmax(F.transform("_s", lambda e: e["s"] * scale))).alias("confidence"),
                      F.transform(F.filter("_s", lambda e: e["s"] > multi_floor), lambda e: e["label"]).alias("labels"))


MAX_VOCABULARY = 1000


def unembedded(content: DataFrame, stored: DataFrame, text: str) -> DataFrame:
    """One row per content hash that has no stored vector yet: ``content_key`` and the text."""
    hashed = content.select(F.sha2(text, 256).alias("content_key"), text).dropDuplicates(["content_key"])
    return hashed.join(stored.select("content_key"), "content_key", "left_anti")
