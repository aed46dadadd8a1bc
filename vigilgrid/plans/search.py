"""Search over detections: scoring, re-ranking, action checks and the hybrid plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.functions import text as X, vectors as V
from vigilgrid.operators import filters as P, joins as J, ranking as K
from vigilgrid.operators.ordered import forward_fill

MOVING_SHARE = 0.05
HALF_LIFE_HOURS = 24.0


def displacement(detections: DataFrame, at_least: int = 3) -> DataFrame:
    """Net motion of each (segment, track) from first to last frame, in shares of the frame.

    Tracks of fewer rows are left out. Adds the time span of the track.
    """
    order = F.struct("frame_number", "det_id")
    centre = F.struct((F.col("bbox_x") + F.col("bbox_w") / 2).alias("x"),
                      (F.col("bbox_y") + F.col("bbox_h") / 2).alias("y"), F.col("timestamp_ms").alias("t"))
    ends = detections.groupBy("segment_id", "track_id").agg(
        F.min_by(centre, order).alias("a"), F.max_by(centre, order).alias("z"), F.count(F.lit(1)).alias("n"))
    dist = F.sqrt((F.col("z.x") - F.col("a.x")) ** 2 + (F.col("z.y") - F.col("a.y")) ** 2)
    return ends.where(F.col("n") >= at_least).select(
        "segment_id", "track_id", dist.alias("displacement"), (dist >= MOVING_SHARE).alias("moving"),
        F.col("a.t").alias("event_start_ms"), F.col("z.t").alias("event_end_ms"))


def moving_hits(hits: DataFrame, detections: DataFrame, action: str, object_class: str | None,
                score: str = "score") -> DataFrame:
    """Best hit of each track that moved, with its time window and an honest status text."""
    tracks = displacement(detections.join(hits.select("segment_id", "track_id").distinct(),
                                          ["segment_id", "track_id"], "left_semi")).where("moving")
    ranked = hits.withColumn("_neg", -F.col("det_id"))
    best = K.latest_per_key(ranked, ["segment_id", "track_id"], [score, "_neg"]).drop("_neg")
    status = (f"{(object_class or 'Object').capitalize()} detected moving, but '{action}' motion could not be "
              "reliably verified from 2D trajectory.")
    return best.join(tracks.select("segment_id", "track_id", "event_start_ms", "event_end_ms"),
                     ["segment_id", "track_id"]).withColumn("action_status", F.lit(status)).withColumn(
        "action_verified", F.lit(False))


def standalone_queries(turns: DataFrame, cues: Sequence[str] = ("only", "show", "just"),
                       turns_per_chunk: int = 10_000) -> DataFrame:
    """User turns; one containing a cue word is prefixed with the session's previous user turn."""
    said = F.when(F.col("role") == "user", F.col("content"))
    filled = forward_fill(turns, ["session_id"], ["turn"], said, F.floor(F.col("turn") / turns_per_chunk),
                          "before", include_current=False)
    cue = F.lit(False)
    for c in cues:
        cue = cue | F.lower("content").contains(c)
    merged = F.trim(F.concat(F.coalesce("before", F.lit("")), F.lit(" "), F.col("content")))
    return filled.where(F.col("role") == "user").withColumn(
        "standalone", F.when(cue, merged).otherwise(F.col("content"))).drop("before")


def matched_share(intent: dict, label: Column, dominant: Column, upper: Column, lower: Column,
                  style: Column, carried: Column, gender: Column, classes: Column | None = None) -> Column:
    """Share of the intent's attributes a hit satisfies; 1 when the intent names none."""
    checks = []
    wanted = intent.get("object_class")
    if wanted:
        wanted = wanted.lower()
        also = ["car", "vehicle", "automobile"] if wanted == "car" else [wanted]
        hit = F.coalesce(F.lower(label).isin(*also), F.lit(False))
        if classes is not None:
            lowered = F.transform(classes, F.lower)
            hit = hit | F.coalesce(F.arrays_overlap(lowered, F.array(*[F.lit(a) for a in also[:2]])), F.lit(False))
        checks.append(hit)
    if intent.get("color"):
        c = intent["color"].lower()
        checks.append(F.array_contains(F.array(*[F.coalesce(F.lower(v), F.lit("")) for v in (dominant, upper, lower)]), c))
    if intent.get("vehicle_style"):
        checks.append(F.lower(style) == intent["vehicle_style"].lower())
    for item in intent.get("attributes") or []:
        checks.append(F.array_contains(F.transform(carried, F.lower), item.lower()))
    if intent.get("gender"):
        checks.append(F.lower(gender) == intent["gender"].lower())
    if not checks:
        return F.lit(1.0)
    total = F.lit(0)
    for c in checks:
        total = total + F.when(c, 1).otherwise(0)
    return total / F.lit(float(len(checks)))


def rerank(hits: DataFrame, intent: dict, as_of_ms: int, half_life_hours: float = HALF_LIFE_HOURS) -> DataFrame:
    """0.4 semantic + 0.4 matched attributes + 0.2 recency; adds the parts and ``rerank_score``.

    A missing score counts 0.5; a missing time counts as now. ``time_ms`` is absolute.
    """
    have = set(hits.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    share = matched_share(intent, col("class_label"), col("dominant_colour"), col("upper_colour"), col("lower_colour"),
                          col("vehicle_type"), F.coalesce(col("carried_items", "array<string>"), F.array().cast("array<string>")),
                          col("gender_estimate"), col("object_classes", "array<string>"))
    semantic = F.least(F.greatest(F.coalesce(col("score", "double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    when = F.when(col("time_ms", "long") != 0, col("time_ms", "long")).otherwise(F.lit(as_of_ms))
    hours = F.abs(F.lit(as_of_ms) - when) / 3_600_000.0
    decay = F.exp(-0.693 * hours / half_life_hours)
    return (hits.withColumn("semantic_score", semantic).withColumn("metadata_score", share)
            .withColumn("temporal_decay", decay)
            .withColumn("rerank_score", 0.4 * F.col("semantic_score") + 0.4 * F.col("metadata_score")
                        + 0.2 * F.col("temporal_decay")))


def rerank_by_text(hits: DataFrame, query: Column, document: Column) -> DataFrame:
    """0.3 clipped vector score + 0.7 text similarity."""
    clipped = F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return hits.withColumn("rerank_score", 0.3 * clipped + 0.7 * X.text_similarity(query, document))


def keyword_score(query: str, wanted: Sequence[str], classes: Column, description: Column, camera: Column) -> Column:
    """Class in the list +0.5, else in the text +0.2; each query word in the text +0.3;
    min(0.95, 0.5 + a tenth of that). Null when nothing matched, unless the query is empty or *."""
    text = F.lower(F.concat_ws(" ", description, F.array_join(classes, " "), camera))
    words = [w.strip().lower() for w in query.split() if len(w.strip()) > 2] or [query.strip().lower()]
    total = F.lit(0.0)
    for c in wanted:
        total = total + F.when(F.array_contains(classes, c.lower()), 0.5).when(text.contains(c.lower()), 0.2).otherwise(0.0)
    for w in words:
        total = total + F.when(text.contains(w), 0.3).otherwise(0.0)
    score = F.round(F.least(F.lit(0.95), 0.5 + total * 0.1), 3)
    return score if query.strip() in ("", "*") else F.when(total > 0, score)


def frame_scores(crops: DataFrame, frames: DataFrame, probe: Column, query: str, target_class: str | None) -> DataFrame:
    """0.6 best crop + 0.4 frame similarity, +0.15 class present, +0.20 colour or clothing named,
    +0.25 when as many crops match as the query counts. ``crops``: frame_id, label, color,
    clothing, embedding; ``frames``: frame_id, embedding."""
    q = query.lower()
    sim = V.dot(F.col("embedding"), probe)
    same = (F.col("label") == target_class) if target_class else F.lit(True)
    named = F.lit(q).contains(F.col("color")) | F.lit(q).contains(F.col("clothing"))
    hit = (sim > 0.22) & same
    per = crops.groupBy("frame_id").agg(
        F.max(sim).alias("best"), F.count_if(hit).alias("matching"), F.coalesce(F.bool_or(hit & named), F.lit(False)).alias("named"),
        F.bool_or(F.col("label") == target_class).alias("present") if target_class else F.lit(False).alias("present"))
    counted = 2 if ("2 " in q or "two " in q) else 3 if ("3 " in q or "three " in q) else None
    zero = F.lit(0.0)
    score = (F.greatest(F.coalesce("best", F.lit(-1.0)), zero) * 0.6 + F.greatest(sim, zero) * 0.4
             + F.when(F.col("present"), 0.15).otherwise(0.0) + F.when(F.col("named"), 0.20).otherwise(0.0))
    if counted:
        score = score + F.when(F.col("matching") >= counted, 0.25).otherwise(0.0)
    return frames.join(per, "frame_id", "left").select("frame_id", score.alias("score"))


def metadata_hits(detections: DataFrame, intent: dict) -> DataFrame:
    """Detections matching every attribute the intent names."""
    c = F.col
    test = F.lit(True)
    if intent.get("object_class"):
        test = test & P.class_is(c("class_label"), intent["object_class"])
    if intent.get("color"):
        test = test & P.colour_is(intent["color"], intent.get("object_class") == "person",
                                  c("dominant_colour"), c("upper_colour"), c("lower_colour"))
    if intent.get("vehicle_style"):
        test = test & P.style_is(c("vehicle_type"), intent["vehicle_style"])
    if intent.get("attributes"):
        test = test & P.carries_all(c("carried_items"), intent["attributes"])
    if intent.get("gender"):
        test = test & P.gender_is(c("gender_estimate"), intent["gender"])
    return detections.where(test)


def hybrid_search(detections: DataFrame, segments: DataFrame, semantic: DataFrame, intent: dict, as_of_ms: int,
                  limit: int = 10, allowed: DataFrame | None = None, start=None, end=None, offset: int = 0) -> DataFrame:
    """Metadata matches, topped up from ``semantic`` hits when short, placed on cameras, checked for
    motion on action queries, re-ranked and cut: one plan from scans to page.

    ``semantic`` holds ``det_id, score`` and any hit columns. Detections need ``time_ms``.
    """
    rows = metadata_hits(detections, intent).where(P.started_between(F.col("segment_start"), start, end))
    if allowed is not None:
        rows = J.on_allowed_cameras(rows, segments, allowed)
    reach = limit + offset
    strict = K.top(rows.withColumn("score", F.lit(None).cast("double")), "confidence", "det_id", reach)
    hits = J.top_up(strict, semantic, "det_id", reach, "score")
    placed = J.attach_camera(hits if "camera_id" in hits.columns else hits.withColumn("camera_id", F.lit(None).cast("long")), segments)
    if intent.get("action"):
        placed = moving_hits(placed, detections, intent["action"], intent.get("object_class"), "confidence")
    return K.page(rerank(placed, intent, as_of_ms), "rerank_score", "det_id", limit, offset)
