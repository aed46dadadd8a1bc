"""Redaction, retention, audit and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.functions import vectors as V
from vigilgrid.plans.reports import ago

NOBODY = "00000000-0000-0000-0000-000000000000"
REDACTED = "[REDACTED]"
# Days each table is kept; the audit log is kept for good.
RETENTION_DAYS = {"video_segments": 90, "detected_objects": 90, "events": 365, "search_queries": 90,
                  "chat_history": 90, "frame_embeddings": 30, "tracks": 30, "audit_log": None}
# Attribute values that extraction may give, and the labels of vehicles.
KNOWN_COLOURS = ["red", "blue", "green", "yellow", "black", "white", "grey", "silver", "orange", "purple", "brown",
                 "pink", "beige", "navy", "maroon", "cyan", "magenta", "gold", "tan", "olive", "teal", "coral", "cream",
                 "charcoal", "khaki", "lavender", "turquoise", "burgundy", "ivory", "dark", "light"]
KNOWN_VEHICLES = ["suv", "sedan", "truck", "van", "motorcycle", "bus", "hatchback", "coupe", "pickup", "minivan",
                  "convertible", "wagon", "crossover"]
KNOWN_GENDERS = ["male", "female"]
VEHICLE_LABELS = ["car", "truck", "bus", "motorcycle", "vehicle"]


def deidentify(searches: DataFrame, as_of: str, days: int = 30, nobody=NOBODY) -> DataFrame:
    """Wipe text and user of searches older than ``days``; running it again changes nothing.

    Adds ``redacted_now`` so that a job can count what it changed.
    """
    due = (F.col("created_at") < ago(as_of, days=days)) & (F.col("query_text") != REDACTED)
    return searches.withColumn("redacted_now", due).withColumn(
        "user_id", F.when(due, F.lit(nobody)).otherwise(F.col("user_id"))).withColumn(
        "query_text", F.when(due, F.lit(REDACTED)).otherwise(F.col("query_text")))


def retained(df: DataFrame, table: str, ts: str, as_of: str) -> DataFrame:
    days = RETENTION_DAYS[table]
    return df if days is None else df.where(F.col(ts) >= ago(as_of, days=days))


def retention_counts(df: DataFrame, table: str, ts: str, as_of: str) -> DataFrame:
    days = RETENTION_DAYS[table]
    gone = F.lit(False) if days is None else F.coalesce(F.col(ts) < ago(as_of, days=days), F.lit(False))
    return df.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("expired")).select(
        F.lit(table).alias("table_name"), "kept", "expired")


def change_audit(old: DataFrame, new: DataFrame, key: Sequence[str], table: str, org: str = "org_id") -> DataFrame:
    """INSERT, UPDATE and DELETE rows between two snapshots, with old and new row as JSON.

    The organisation comes from the row itself. Both snapshots must have the same columns.
    """
    key, cols = list(key), old.columns
    a = old.select(*key, F.struct(*cols).alias("_old"))
    b = new.select(*key, F.struct(*cols).alias("_new"))
    both = a.join(b, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    action = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(*key, F.lit(table).alias("table_name"), action.alias("action"),
                       F.coalesce(F.col(f"_new.{org}"), F.col(f"_old.{org}")).alias("org_id"),
                       F.to_json("_old").alias("old_data"), F.to_json("_new").alias("new_data"))


def missing_keys(df: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose JSON payload is not an object holding every key."""
    have = F.json_object_keys(payload)
    return df.where(~F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), have)) == 0, F.lit(False)))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def without_orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """What a cascading delete leaves: children whose parent still exists."""
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def unlink_missing(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Set the link to null where the linked row is gone."""
    alive = parents.select(key).distinct().withColumn("_alive", F.lit(True))
    return children.join(alive, key, "left").withColumn(key, F.when(F.col("_alive"), F.col(key))).drop("_alive")


def slim_text(content: Column, longest: int = 2000) -> Column:
    """Message body cut for a stored snapshot."""
    return F.when(F.length(content) > longest, F.concat(F.substring(content, 1, longest), F.lit("... [truncated]"))).otherwise(content)


def strip_binary(value: Column) -> Column:
    return F.when(value.startswith("data:") | value.startswith("blob:") | (F.length(value) > 10_000),
                  "[binary data stripped]").otherwise(value)


def slim_snapshot(matches: Column, keep: int = 20) -> Column:
    return F.slice(matches, 1, keep)


def encrypted(value: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce per value; null stays null."""
    return F.aes_encrypt(value, key)


def decrypted(token: Column, key: Column) -> Column:
    return F.aes_decrypt(token, key).cast("string")


def pending(df: DataFrame, done: str) -> DataFrame:
    """Rows not processed yet."""
    return df.where(~F.coalesce(F.col(done), F.lit(False)))


def attribute_issues(detections: DataFrame, id_col: str) -> DataFrame:
    """One row per faulty attribute: id, field and what is wrong."""
    c = F.col
    vehicle, person = F.lower("class_label").isin(VEHICLE_LABELS), F.lower("class_label") == "person"

    def issue(field: str, test: Column, text: str) -> Column:
        return F.when(test, F.struct(F.lit(field).alias("field_name"), F.lit(text).alias("issue")))

    def unknown(name: str, known: list[str]) -> Column:
        return c(name).isNotNull() & ~F.lower(name).isin(known)

    have = set(detections.columns)
    checks = [issue("dominant_colour", unknown("dominant_colour", KNOWN_COLOURS), "unknown colour"),
              issue("dominant_colour", c("dominant_colour").isNull(), "no colour though attributes were extracted"),
              issue("vehicle_type", vehicle & unknown("vehicle_type", KNOWN_VEHICLES), "unknown vehicle type"),
              issue("gender_estimate", unknown("gender_estimate", KNOWN_GENDERS), "unknown gender")]
    checks += [issue(f, person & unknown(f, KNOWN_COLOURS), "unknown colour") for f in ("upper_colour", "lower_colour")]
    for f, scope in (("colour_confidence", F.lit(True)), ("vehicle_type_confidence", vehicle), ("upper_colour_conf", person), ("lower_colour_conf", person)):
        if f in have:
            checks.append(issue(f, scope & c(f).isNotNull() & ~c(f).between(0.0, 1.0), "outside 0 to 1"))
    if "carried_items" in have:
        # Text that is no JSON, or JSON of another kind, is a fault; no items at all are none.
        kind = F.schema_of_variant(F.try_parse_json("carried_items"))
        listed = F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))
        checks.append(issue("carried_items", c("carried_items").isNotNull() & ~listed, "neither a list nor an object"))
    return detections.select(id_col, F.explode(F.array_compact(F.array(*checks))).alias("i")).select(id_col, "i.*")


def attribute_report(detections: DataFrame, id_col: str) -> DataFrame:
    """Issue counts per field and the share of rows without any."""
    bad = attribute_issues(detections, id_col)
    fields = bad.groupBy("field_name").agg(F.count(F.lit(1)).alias("issues"))
    totals = detections.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1)).join(
        bad.select(id_col).distinct().agg(F.count(F.lit(1)).alias("bad")).withColumn("_one", F.lit(1)), "_one")
    return fields.withColumn("_one", F.lit(1)).join(totals, "_one").select(
        "field_name", "issues", F.round((F.col("n") - F.col("bad")) / F.col("n"), 6).alias("valid_share"))


def gallery_report(gallery: DataFrame, vector: str, dim: int = 512, tolerance: float = 0.01,
                   kinds: Sequence[str] = ("person", "car", "vehicle")) -> DataFrame:
    """Dimension, norm range and type validity over all profiles."""
    sized = gallery.withColumn("_n", V.norm(F.col(vector))).withColumn("_d", F.size(vector))
    return sized.agg(
        F.count(F.lit(1)).alias("profiles"), F.count_if(F.col("_d") == dim).alias("right_dimension"),
        F.count_if(F.abs(F.col("_n") - 1.0) <= tolerance).alias("unit_norm"), F.round(F.min("_n"), 5).alias("norm_min"),
        F.round(F.max("_n"), 5).alias("norm_max"), F.round(F.avg("_n"), 5).alias("norm_mean"),
        F.count_if(F.lower("object_type").isin(*kinds)).alias("valid_types"))
