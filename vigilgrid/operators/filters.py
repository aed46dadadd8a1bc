"""Row predicates, each a Column or a DataFrame-to-DataFrame helper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.functions import geometry as G

# Taxonomy of the small detector, thresholds and groups.
TARGET_CLASSES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
TAXONOMY = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "street sign", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep",
    "cow", "elephant", "bear", "zebra", "giraffe", "hat", "backpack", "umbrella", "shoe", "eye glasses", "handbag",
    "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove",
    "skateboard", "surfboard", "tennis racket", "bottle", "plate", "wine glass", "cup", "fork", "knife", "spoon",
    "bowl", "banana", "apple", "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake",
    "chair", "couch", "potted plant"]
VEHICLE_GROUP = ["car", "motorcycle", "bus", "truck", "bicycle", "train", "boat", "airplane"]
GROUP_THRESHOLDS = {"person": 0.4, "vehicle": 0.5, "object": 0.3}
CLASS_THRESHOLDS = {"bicycle": 0.50, "motorcycle": 0.50, "person": 0.42}
DEFAULT_THRESHOLD = 0.45


def for_tenant(df: DataFrame, org) -> DataFrame:
    """Rows of one organisation; without one there are none."""
    return df.where(F.lit(False)) if org is None else df.where(F.col("org_id") == F.lit(org))


def live_rows(df: DataFrame) -> DataFrame:
    """Rows not soft-deleted, by ``deleted_at`` or the ``is_deleted`` flag, whichever exists."""
    return df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df.where(~F.col("is_deleted"))


def class_is(label: Column, wanted: str) -> Column:
    wanted = wanted.lower()
    return F.lower(label).isin("car", "vehicle") if wanted == "car" else F.lower(label) == wanted


def colour_is(wanted: str, person: bool, dominant: Column, upper: Column, lower: Column) -> Column:
    wanted = wanted.lower()
    hit = F.lower(dominant) == wanted
    return (F.lower(upper) == wanted) | (F.lower(lower) == wanted) | hit if person else hit


def style_is(vehicle_type: Column, wanted: str) -> Column:
    return F.lower(vehicle_type) == wanted.lower()


def gender_is(gender: Column, wanted: str) -> Column:
    return F.lower(gender) == wanted.lower()


def carries_all(carried: Column, items: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(i) for i in items]), carried)) == 0


def carries_all_json(carried_json: Column, items: Sequence[str]) -> Column:
    """The object form: every item is a key."""
    return carries_all(F.json_object_keys(carried_json), items)


def started_between(ts: Column, start=None, end=None) -> Column:
    test = F.lit(True)
    if start is not None:
        test = test & (ts >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        test = test & (ts <= F.to_timestamp_ntz(F.lit(end)))
    return test


def spans_overlap(first: Column, last: Column, start, end) -> Column:
    test = F.lit(True)
    if start is not None:
        test = test & (last >= F.lit(start))
    if end is not None:
        test = test & (first <= F.lit(end))
    return test


def vector_filter(collection: str, cameras: Sequence | None = None, start_ms: int | None = None,
                  end_ms: int | None = None, classes: Sequence[str] = (), synonyms: Sequence[str] = (),
                  excluded: Sequence[str] = ()) -> Column:
    """One predicate for a vector collection: frames, objects or events.

    ``cameras`` None means unrestricted; an empty list means no rows.
    """
    first, last = {"frames": ("timestamp_ms", "timestamp_ms"), "objects": ("first_seen", "last_seen"),
                   "events": ("start_time", "end_time")}[collection]
    label = {"objects": "class_label", "events": "event_type"}.get(collection)
    test = spans_overlap(F.col(first), F.col(last), start_ms, end_ms)
    if cameras is not None:
        test = test & (F.col("camera_id").isin(*cameras) if cameras else F.lit(False))
    wanted = sorted(set(classes) | set(synonyms))
    if wanted:
        test = test & (F.col(label).isin(*wanted) if label else
                       F.arrays_overlap("object_classes", F.array(*[F.lit(c) for c in wanted])))
    if excluded:
        test = test & (~F.col(label).isin(*excluded) if label else
                       ~F.arrays_overlap("object_classes", F.array(*[F.lit(c) for c in excluded])))
    return test


def not_about(classes: Column, description: Column, excluded: Sequence[str]) -> Column:
    """Neither the class list nor the description mentions an excluded word."""
    hit = F.lit(False)
    for word in excluded:
        hit = hit | F.array_contains(classes, word.lower()) | F.lower(description).contains(word.lower())
    return ~F.coalesce(hit, F.lit(False))


def group_threshold(label: Column, thresholds: dict[str, float] = GROUP_THRESHOLDS) -> Column:
    return (F.when(label == "person", thresholds["person"]).when(label.isin(*VEHICLE_GROUP), thresholds["vehicle"])
            .otherwise(thresholds["object"]))


def class_threshold(label: Column, overrides: dict[str, float] = CLASS_THRESHOLDS,
                    default: float = DEFAULT_THRESHOLD) -> Column:
    out = F.lit(default)
    for name, value in overrides.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def plausible_box(b: Column, frame_w: int, frame_h: int, min_area: float = 400.0, max_share: float = 0.60,
                  min_aspect: float = 0.15, max_aspect: float = 6.5) -> Column:
    """Size and shape limits of an already clamped box."""
    w, h = G.width(b), G.height(b)
    aspect = F.round(w / F.when(h != 0, h), 3)
    return F.coalesce((w * h >= min_area) & (w * h <= max_share * frame_w * frame_h) & (w != 0) & (h != 0)
                      & aspect.between(min_aspect, max_aspect), F.lit(False))


def taxonomy_label(class_id: Column) -> Column:
    names = F.array(*[F.lit(n) for n in TAXONOMY])
    return F.when(class_id.between(0, len(TAXONOMY) - 1), F.element_at(names, (class_id + 1).cast("int"))).otherwise("object")


def target_label(class_id: Column) -> Column:
    """Label of a target class; null for ids to drop."""
    out = F.lit(None).cast("string")
    for cid, name in TARGET_CLASSES.items():
        out = F.when(class_id == cid, F.lit(name)).otherwise(out)
    return out


def record_fault(class_id: Column, label: Column, confidence: Column, corners: Sequence[Column],
                 others: Sequence[Column], floor: float = 0.35) -> Column:
    """Why a detection record is unusable, null when it is fine. Corners must be whole numbers."""
    missing, ragged = F.lit(False), F.lit(False)
    for c in (class_id, label, confidence, *corners, *others):
        missing = missing | c.isNull()
    for c in corners:
        ragged = ragged | (c != F.floor(c))
    known = target_label(class_id)
    return (F.when(missing, "missing field").when(known.isNull(), "unknown class")
            .when(known != label, "label mismatch").when(confidence < floor, "low confidence")
            .when(ragged, "bbox not integer"))


def acceptable_quality(blur: Column, luminance: Column, similarity: Column) -> Column:
    return ~((blur < 100) & (luminance < 20)) & ~(similarity > 0.98)


def sampled(frame_id: Column, fps: Column) -> Column:
    return frame_id % F.greatest(F.lit(1), F.floor(fps / 1.5)) == 0


def every_fifth(frame_id: Column) -> Column:
    return (frame_id == 1) | (frame_id % 5 == 0)
