"""Surveillance-shaped views over the driver's tables.

Each view exists twice, as a Spark DataFrame and as SQL text, and both say the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
AS_OF_MS = 1706659200000
SEGMENTS_AS_OF = "2001-06-01 00:00:00"

VIEWS: dict[str, tuple[str, str]] = {}


def _view(name: str, table: str, columns: list[tuple[str, str, str]], where: str | None = None) -> None:
    spark_text = ", ".join(f"{s} AS {n}" for n, s, _ in columns)
    duck_text = ", ".join(f"{d or s} AS {n}" for n, s, d in columns)
    tail = f" WHERE {where}" if where else ""
    VIEWS[name] = (f"SELECT {spark_text} FROM {{{table}}}{tail}", f"SELECT {duck_text} FROM {table}{tail}")


def _pick(selector: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {selector} {whens} ELSE '{values[-1]}' END"


SEVERITY = "CASE WHEN value >= 100 THEN 'critical' WHEN value >= 30 THEN 'warning' ELSE 'info' END"
K = ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)")

_view("alerts", "events", [
    ("id", "event_id", ""), ("org_id", "user_id % 5", ""), ("camera_id", "user_id % 10", ""),
    ("user_id", "user_id", ""), ("event_type", "event_type", ""), ("severity", SEVERITY, ""),
    ("start_time", "ts", ""), ("start_ms", "unix_millis(CAST(ts AS TIMESTAMP))", "CAST(epoch_us(ts) // 1000 AS BIGINT)"),
    ("value", "value", ""), ("k", *K), ("metadata", "props", "")])

_view("cameras", "supplier", [
    ("camera_id", "s_suppkey", ""), ("org_id", "CAST(s_suppkey % 5 AS BIGINT)", ""), ("name", "s_name", ""),
    ("location", _pick("CAST(s_suppkey % 7 AS INT)", ["North Lobby Entrance", "Parking West level 2", "Parking East ramp",
                       "Rear Loading Bay", "Main Entrance", "Stairwell", "Server room"]), ""),
    ("status", "CASE WHEN s_acctbal >= 2000 THEN 'active' WHEN s_acctbal >= 500 THEN 'offline' "
               "ELSE 'maintenance' END", ""),
    ("nation", "s_nationkey", ""), ("is_deleted", "s_acctbal < 0", "")])

_view("health", "events", [
    ("camera_id", "user_id % 10", ""), ("org_id", "user_id % 5", ""), ("ts", "ts", ""),
    ("uptime_status", "CASE WHEN event_type = 'error' THEN 'offline' ELSE 'online' END", ""),
    ("frame_drop_rate", "value / 10.0", ""), ("detection_latency_ms", "value + 100.0", "")])

_view("segments", "orders", [
    ("segment_id", "o_orderkey", ""), ("org_id", "o_custkey % 5", ""), ("camera_id", "o_custkey % 10", ""),
    ("start_time", "o_orderdate", ""), ("month", "date_format(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')"),
    ("size_bytes", "o_totalprice", ""), ("processing_status", "o_orderstatus", "")])

# (l_orderkey, l_linenumber) repeats in the driver's lineitem, so 20 more bits mix in the other keys.
DET_ID = ("(l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 31337 + l_suppkey * 7 "
          "+ CAST(l_quantity AS BIGINT) * 9973) % 1048576", "")
CLASS = "CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'car' ELSE 'truck' END"
_view("detections", "lineitem", [
    ("det_id", *DET_ID), ("org_id", "l_suppkey % 5", ""), ("segment_id", "l_orderkey", ""),
    ("segment_start", "l_shipdate", ""), ("frame_number", "l_linenumber", ""),
    ("timestamp_ms", "CAST(l_linenumber * 1000 + l_quantity * 10 AS BIGINT)", ""),
    ("class_label", CLASS, ""), ("confidence", "round((l_extendedprice % 100) / 100, 4)", ""),
    ("bbox_x", "l_quantity / 100", ""), ("bbox_y", "l_discount * 5", ""), ("bbox_w", "0.1", "CAST(0.1 AS DOUBLE)"),
    ("bbox_h", "l_tax + 0.05", ""), ("track_id", "l_suppkey", ""), ("gallery_id", "l_partkey % 100", ""),
    ("dominant_colour", "CASE WHEN l_partkey % 13 = 12 THEN NULL ELSE " + _pick(
        "CAST(l_partkey % 13 AS INT)", ["red", "blue", "green", "yellow", "black", "white", "grey", "silver",
                                        "orange", "purple", "brown", "dusk"]) + " END", ""),
    ("upper_colour", _pick("CAST(l_suppkey % 4 AS INT)", ["red", "Blue", "green", "black"]), ""),
    ("lower_colour", _pick("CAST(l_orderkey % 3 AS INT)", ["Black", "blue", "grey"]), ""),
    ("vehicle_type", _pick("CAST(l_partkey % 5 AS INT)", ["SUV", "sedan", "truck", "van", "spaceship"]), ""),
    ("gender_estimate", _pick("CAST(l_orderkey % 4 AS INT)", ["man", "woman", "child", "unknown"]), ""),
    ("created_at", "l_shipdate", "")])

_view("boxes", "lineitem", [
    ("det_id", *DET_ID), ("camera_id", "l_suppkey % 10", ""), ("frame_id", "l_orderkey", ""),
    ("class_label", CLASS, ""), ("score", "round((l_extendedprice % 100) / 100, 4)", ""),
    ("x1", "l_quantity * 10", ""), ("y1", "l_discount * 1000", ""),
    ("x2", "l_quantity * 10 + 80 + 10 * l_linenumber", ""), ("y2", "l_discount * 1000 + 60 + 1000 * l_tax", "")])

_view("points", "events", [
    ("point_id", "event_id", ""), ("camera_id", "user_id % 10", ""), ("track_id", "user_id", ""),
    ("class_id", _pick("CAST(user_id % 5 AS INT)", ["0", "0", "0", "26", "2"]), ""),
    ("ts_ms", "unix_millis(CAST(ts AS TIMESTAMP))", "CAST(epoch_us(ts) // 1000 AS BIGINT)"), ("x", "value", ""),
    ("y", f"CAST({K[0]} AS DOUBLE)", f"CAST({K[1]} AS DOUBLE)")])

QUERY_TEMPLATES = [
    ("'show the '", "' suv in zone-a last '", "' hours'"), ("'man with backpack and '", "' jacket last '", "' minutes'"),
    ("'person not '", "' trucks today '", "' night'"), ("'same car '", "' reversing near cam '", "' yesterday evening'"),
    ("'how many '", "' cars in zone:dock-'", "' this week'"), ("'woman running '", "' hat between '", "'am and 11pm'"),
    ("'camera:cam_9 '", "' vehicles except vans last '", "' days'"), ("'hard hat '", "' vest loitering at cam-'", "' last hour'"),
    ("'which camera saw '", "' dogs but not cats '", "''")]
_view("searches", "part", [
    ("query_id", "p_partkey", ""), ("org_id", "CAST(p_partkey % 5 AS BIGINT)", ""),
    ("user_id", "CAST(p_partkey % 17 AS BIGINT)", ""),
    ("query_text", "CASE CAST(p_partkey % 9 AS INT) " + " ".join(
        f"WHEN {i} THEN concat({a}, split_part(p_name, ' ', 1), {b}, CAST(p_size % 12 AS STRING), {c})"
        for i, (a, b, c) in enumerate(QUERY_TEMPLATES)) + " END", ""),
    ("results_count", "CAST(p_size % 6 AS BIGINT)", ""), ("latency_ms", "p_retailprice % 97", ""),
    ("created_at", "timestamp_ntz'2023-12-22 00:00:00' + make_dt_interval(0, 0, CAST((p_partkey * 43) % 57600 AS INT), 0)",
     "TIMESTAMP '2023-12-22 00:00:00' + to_minutes(CAST((p_partkey * 43) % 57600 AS INTEGER))")])

_view("crops", "embeddings", [
    ("crop_id", "vec_id", ""), ("org_id", "vec_id % 2", ""), ("camera_id", "vec_id % 5", ""),
    ("frame_id", "CAST(floor(vec_id / 10) AS BIGINT)", "CAST(vec_id // 10 AS BIGINT)"), ("label", "label", ""),
    ("track_id", "CAST(label AS BIGINT)", ""), ("embedding", "embedding", "")])

_view("turns", "conversations", [
    ("session_id", "conv_id", ""), ("turn", "turn", ""), ("role", "role", ""), ("content", "text", "")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a lazily planned DataFrame; pruning reaches the Parquet scan."""
    text, _ = VIEWS[name]
    source = text[text.index("{") + 1:text.index("}")]
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


def view_sql(*names: str) -> str:
    """The same views as a list of common table expressions."""
    return ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
