"""Text, hashing, cursor and label helpers as column expressions."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# OpenCV-scale hue ranges and the twelve colour names, in rule order.
HUE_NAMES = [(0, 10, "red"), (10, 25, "orange"), (25, 35, "yellow"), (35, 85, "green"),
             (85, 100, "cyan"), (100, 130, "blue"), (130, 145, "purple"), (145, 170, "pink")]

# US dollars per thousand tokens, (input, output).
TOKEN_PRICES = {"gpt-4o": (0.0025, 0.01), "gpt-4o-mini": (0.00015, 0.0006),
                "claude-3-5-sonnet-20241022": (0.003, 0.015), "claude-3-haiku-20240307": (0.00025, 0.00125)}


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def singular(word: Column) -> Column:
    return F.when(word.endswith("s") & (F.length(word) > 1), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def intent_key(query: Column) -> Column:
    """Cache key of a parsed query: prefix and 16 hex digits of the normalised text's hash."""
    return F.concat(F.lit("intent:"), F.substring(F.sha2(F.trim(F.lower(query)), 256), 1, 16))


def search_key(query: Column, filters: Column, cameras: Column, limit: Column, cursor: Column) -> Column:
    """Cache key of a search over its normalised text, filters (JSON text), sorted cameras and page."""
    parts = F.concat(F.lit("q:"), F.lower(F.trim(query)), F.lit("|f:"), filters, F.lit("|c:"),
                     F.array_join(F.array_sort(cameras), ","), F.lit("|l:"), limit.cast("string"),
                     F.lit("|cur:"), F.coalesce(cursor, F.lit("")))
    return F.concat(F.lit("search:"), F.md5(parts))


def cursor_of(offset: Column) -> Column:
    return F.base64(offset.cast("string").cast("binary"))


def offset_of(cursor: Column) -> Column:
    """Offset inside a cursor; 0 for a missing or malformed one."""
    decoded = F.try_to_binary(cursor, F.lit("base64"))
    return F.coalesce(decoded.cast("string").try_cast("long"), F.lit(0).cast("long"))


def next_cursor(returned: Column, limit: int, cursor: Column) -> Column:
    """Cursor of the following page, null after a short page."""
    return F.when(returned >= limit, cursor_of(offset_of(cursor) + limit))


def age_label(ts_ms: Column, as_of_ms: Column) -> Column:
    """Just now, n min ago, Today h:mm, Yesterday h:mm, else day and month (UTC)."""
    ts, now = F.timestamp_millis(ts_ms), F.timestamp_millis(as_of_ms)
    diff = as_of_ms - ts_ms
    clock = F.date_format(ts, "h:mm a")
    return (F.when(diff < 60_000, F.lit("Just now"))
            .when(diff < 3_600_000, F.concat(F.floor(diff / 60_000).cast("string"), F.lit(" min ago")))
            .when(F.to_date(ts) == F.to_date(now), F.concat(F.lit("Today "), clock))
            .when(F.to_date(ts) == F.date_sub(F.to_date(now), 1), F.concat(F.lit("Yesterday "), clock))
            .otherwise(F.date_format(ts, "d MMM")))


def colour_name(h: Column, s: Column, v: Column) -> Column:
    """Hue 0-180, saturation and value 0-255 to a colour name; first rule that fits wins."""
    named = (F.when(v < 50, "black").when((s < 30) & (v > 200), "white")
             .when((s < 40) & v.between(50, 200), "grey")
             .when(h.between(10, 20) & (s > 80) & (v < 150), "brown")
             .when(h.between(0, 10) | h.between(170, 180), "red"))
    for low, high, name in HUE_NAMES[1:]:
        named = named.when((h >= low) & (h < high), name)
    return named.otherwise("grey")


def scene_description(detections: Column) -> Column:
    """Frame summary from structs label, color, clothing."""
    coloured = ["car", "truck", "motorcycle", "bus"]
    items = F.transform(detections, lambda d: F.when(
        d["label"] == "person", F.concat(F.lit("person wearing "), d["clothing"]))
        .when(d["label"].isin(coloured), F.concat_ws(" ", d["color"], d["label"])).otherwise(d["label"]))
    return F.when(F.size(detections) > 0, F.concat(F.lit("Frame contains: "), F.array_join(items, ", "))
                  ).otherwise(F.lit("Empty scene"))


def document_text(kind: Column, camera: Column, label: Column, severity: Column, description: Column,
                  classes: Column, det_labels: Column) -> Column:
    """Sentence a result is re-ranked by; ``kind`` is event, object or frame."""
    desc = F.coalesce(description, F.lit(""))
    event = F.trim(F.concat(F.lit("An event of type "), label, F.lit(" with severity "), severity,
                            F.lit(". "), desc))
    obj = F.concat(F.lit("A cropped object of class "), label, F.lit(" spotted on camera "), camera, F.lit("."))
    frame = (F.when(desc != "", F.concat(F.lit("A frame on camera "), camera, F.lit(" showing: "), desc))
             .when(F.size(det_labels) > 0, F.concat(F.lit("A frame on camera "), camera,
                   F.lit(" containing: "), F.array_join(det_labels, ", "), F.lit(".")))
             .when(F.size(classes) > 0, F.concat(F.lit("A frame on camera "), camera,
                   F.lit(" showing: "), F.array_join(classes, ", "), F.lit(".")))
             .otherwise(F.concat(F.lit("A video frame recorded on camera "), camera, F.lit("."))))
    return F.when(kind == "event", event).when(kind == "object", obj).otherwise(frame)


def token_share(query: Column, document: Column) -> Column:
    """Distinct query words also in the document, over distinct query words."""
    q = _words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, _words(document))) / F.size(q)).otherwise(F.lit(0.0))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the standard library has it, Spark does not."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def text_similarity(query: Column, document: Column) -> Column:
    return F.when(F.size(_words(query)) > 0,
                  0.4 * sequence_ratio(F.lower(query), F.lower(document)) + 0.6 * token_share(query, document)
                  ).otherwise(F.lit(0.0))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a call, 0 for an unknown model, rounded to 6 decimals."""
    cost_in, cost_out = F.lit(0.0), F.lit(0.0)
    for name, (p_in, p_out) in TOKEN_PRICES.items():
        cost_in = F.when(model == name, F.lit(p_in)).otherwise(cost_in)
        cost_out = F.when(model == name, F.lit(p_out)).otherwise(cost_out)
    return F.round(tokens_in / 1000.0 * cost_in + tokens_out / 1000.0 * cost_out, 6)


def drop_keys(words: list[str]):
    """Pandas UDF removing JSON object keys that contain one of ``words``, at any depth of objects."""

    def clean(node):
        if isinstance(node, dict):
            return {k: clean(v) for k, v in node.items() if not any(w in k.lower() for w in words)}
        return node

    @F.pandas_udf(T.StringType())
    def run(payload: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(clean(json.loads(t))) if isinstance(t, str) else None for t in payload], dtype=object)

    return run
