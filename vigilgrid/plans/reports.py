"""Dashboard reports. Each is one plan; ``as_of`` stands in for the wall clock.

Empty inputs give empty or null results. ``org`` goes through the tenant filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilgrid.operators.filters import live_rows, for_tenant
from vigilgrid.operators import rollups as R

# Zones in match order with the words that place a camera in them.
ZONE_WORDS = {
    "lobby": ["Front Desk", "Lobby Camera", "Lobby Entrance", "Lobby"],
    "parking_lot_a": ["Parking West", "parking-west", "Parking Lot A"],
    "parking_lot_b": ["Parking East", "parking-east", "Parking Lot B"],
    "loading_dock": ["Loading Bay", "Dock Loading", "Loading Dock"],
    "entrance": ["Main Entrance", "Entrance Gate", "Entrance"],
}
VEHICLE_LABELS = ["vehicle", "car", "suv", "truck"]
PERSON_LABELS = ["person", "people"]


def as_time(as_of: str) -> Column:
    return F.to_timestamp_ntz(F.lit(as_of))


def ago(as_of: str, **parts: int) -> Column:
    interval = F.make_dt_interval(*[F.lit(parts.get(p, 0)) for p in ("days", "hours", "mins")])
    return as_time(as_of) - interval


def zone_of_camera(name: Column, location: Column) -> Column:
    """First zone one of whose words occurs in the name or location; lobby otherwise."""
    zone = F.lit(None).cast("string")
    for key, words in ZONE_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(name).contains(w.lower()) | F.lower(location).contains(w.lower())
        zone = F.coalesce(zone, F.when(hit, F.lit(key)))
    return F.coalesce(zone, F.lit("lobby"))


def recent(rows: DataFrame, ts: str, as_of: str, **parts: int) -> DataFrame:
    """Raw rows that any bucket of the last ``parts`` can hold, so that the time bound reaches the scan.

    A bucket no older than the bound holds no row before it; what else this leaves of older buckets
    the report's own filter removes.
    """
    return rows.where(F.col(ts) >= ago(as_of, **parts))


def realtime_kpis(cameras: DataFrame, hourly: DataFrame, searches: DataFrame, org, as_of: str) -> DataFrame:
    cams = live_rows(for_tenant(cameras, org)).agg(
        F.count(F.lit(1)).alias("total_cameras"), F.count_if(F.col("status") == "active").alias("active_cameras"))
    events = for_tenant(hourly, org).where(F.col("bucket") >= ago(as_of, hours=1)).agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("events_per_hour"))
    recent = for_tenant(searches, org)
    rate = recent.where(F.col("created_at") >= ago(as_of, mins=1)).agg(
        F.count(F.lit(1)).alias("queries_per_minute"))
    latency = R.searches_hourly(recent.where(F.col("created_at") >= a_day_and_an_hour(as_of))).where(
        F.col("bucket") >= ago(as_of, days=1)).agg(
        F.round(F.avg("avg_latency_ms"), 1).alias("average_search_latency_ms"))
    # Four one-row aggregates side by side.
    one = [d.withColumn("_one", F.lit(1)) for d in (cams, events, rate, latency)]
    out = one[0]
    for d in one[1:]:
        out = out.join(d, "_one")
    return out.drop("_one")


def kept_kpis(cameras: DataFrame, hourly: DataFrame, by_second: DataFrame, searches_hourly: DataFrame, org, as_of: str) -> DataFrame:
    """The five values of ``realtime_kpis`` from rollups alone: events and searches by hour, searches by second."""
    cams = live_rows(for_tenant(cameras, org)).agg(
        F.count(F.lit(1)).alias("total_cameras"), F.count_if(F.col("status") == "active").alias("active_cameras"))
    none = F.lit(0).cast("long")
    parts = [for_tenant(hourly, org).where(F.col("bucket") >= ago(as_of, hours=1)).agg(F.coalesce(F.sum("event_count"), none).alias("events_per_hour")),
             for_tenant(by_second, org).where(F.col("bucket") >= ago(as_of, mins=1)).agg(F.coalesce(F.sum("query_count"), none).alias("queries_per_minute")),
             for_tenant(searches_hourly, org).where(F.col("bucket") >= ago(as_of, days=1)).agg(F.round(F.avg("avg_latency_ms"), 1).alias("average_search_latency_ms"))]
    out = cams.withColumn("_one", F.lit(1))
    for p in parts:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def a_day_and_an_hour(as_of: str) -> Column:
    """A day and a part hour back, so that no row of a needed bucket is pruned."""
    return ago(as_of, days=1, hours=1)


def latency_weighted(searches: DataFrame, org, as_of: str) -> DataFrame:
    """True mean over queries next to the mean of hourly means."""
    hourly = R.searches_hourly(for_tenant(searches, org)).where(F.col("bucket") >= ago(as_of, days=30))
    return hourly.agg(
        F.round(F.avg("avg_latency_ms"), 4).alias("mean_of_hours"),
        F.round(F.sum(F.col("avg_latency_ms") * F.col("query_count")) / F.sum("query_count"), 4)
        .alias("mean_of_queries"))


def traffic_heatmap(hourly: DataFrame, cameras: DataFrame, org, as_of: str) -> DataFrame:
    """24 hours by five zones, zero filled, over the last day."""
    by_camera = (for_tenant(hourly, org).where(F.col("bucket") >= ago(as_of, days=1))
                 .groupBy(F.hour("bucket").alias("hour"), "camera_id").agg(F.sum("event_count").alias("n")))
    placed = for_tenant(cameras, org).select(
        "camera_id", zone_of_camera(F.col("name"), F.col("location")).alias("zone"))
    zones = list(ZONE_WORDS)
    filled = (by_camera.join(placed, "camera_id").groupBy("hour")
              .agg(*[F.sum(F.when(F.col("zone") == z, F.col("n")).otherwise(0)).alias(z) for z in zones]))
    hours = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(filled, "hour", "left").select(
        F.col("hour").cast("long").alias("hour"), *[F.coalesce(z, F.lit(0)).alias(z) for z in zones])


def heatmap_bands(heatmap: DataFrame) -> DataFrame:
    """Long form of the heatmap with the share of the largest value (at least 1) and its colour band."""
    zones = list(ZONE_WORDS)
    long = heatmap.select("hour", F.explode(F.array(*[
        F.struct(F.lit(z).alias("zone"), F.col(z).alias("value")) for z in zones])).alias("c")).select("hour", "c.*")
    top = long.agg(F.greatest(F.max("value"), F.lit(1)).alias("top")).withColumn("_one", F.lit(1))
    rated = long.withColumn("_one", F.lit(1)).join(top, "_one").withColumn("ratio", F.col("value") / F.col("top"))
    r = F.col("ratio")
    band = (F.when(F.col("value") == 0, 0).when(r < 0.2, 1).when(r < 0.4, 2).when(r < 0.6, 3)
            .when(r < 0.8, 4).otherwise(5))
    return rated.select("hour", "zone", "value", F.round("ratio", 6).alias("ratio"), band.cast("long").alias("band"))


def object_trends(daily: DataFrame, org, as_of: str, days: int = 90) -> DataFrame:
    kinds = PERSON_LABELS + VEHICLE_LABELS
    rows = for_tenant(daily, org).where(F.col("bucket") >= ago(as_of, days=days))
    return rows.groupBy(F.date_format("bucket", "yyyy-MM-dd").alias("date")).agg(
        F.sum(F.when(F.col("class_label").isin(PERSON_LABELS), F.col("object_count")).otherwise(0)).alias("people"),
        F.sum(F.when(F.col("class_label").isin(VEHICLE_LABELS), F.col("object_count")).otherwise(0)).alias("vehicles"))


def event_distribution(hourly: DataFrame, org) -> DataFrame:
    return for_tenant(hourly, org).groupBy(F.col("event_type").alias("name")).agg(F.sum("event_count").alias("value"))


def severity_totals(hourly: DataFrame, org) -> DataFrame:
    return for_tenant(hourly, org).groupBy("severity").agg(F.sum("event_count").alias("total"))


def peak_hours(hourly: DataFrame, org, as_of: str) -> DataFrame:
    return R.by_hour_of_day(for_tenant(hourly, org).where(F.col("bucket") >= ago(as_of, days=30)))


def camera_health(hourly: DataFrame, cameras: DataFrame, org, as_of: str) -> DataFrame:
    """Uptime percent, drop rate and latency per camera of the last day; null where nothing was logged."""
    agg = (for_tenant(hourly, org).where(F.col("bucket") >= ago(as_of, days=1)).groupBy("camera_id").agg(
        F.round(F.avg("uptime_ratio") * 100, 2).alias("uptime_percent"),
        F.round(F.avg("avg_frame_drop_rate"), 2).alias("frame_drop_rate"),
        F.avg("avg_detection_latency_ms").cast("long").alias("latency_ms")))
    return live_rows(for_tenant(cameras, org)).select("camera_id", "name", "location", "status").join(
        agg, "camera_id", "left")


def troubled_cameras(report: DataFrame) -> DataFrame:
    return report.where((F.col("status") != "active") | (F.col("frame_drop_rate") > 5)
                        | (F.col("uptime_percent") < 98))


def top_queries(searches: DataFrame, org, as_of: str, n: int = 5) -> DataFrame:
    return (for_tenant(searches, org).where(F.col("created_at") >= ago(as_of, days=30))
            .groupBy(F.col("query_text").alias("query")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "query").limit(n))


def search_quality(hourly: DataFrame, org, as_of: str) -> DataFrame:
    agg = for_tenant(hourly, org).where(F.col("bucket") >= ago(as_of, days=30)).agg(
        F.avg("avg_latency_ms").alias("lat"), F.sum("query_count").alias("q"), F.sum("zero_results_count").alias("z"))
    return agg.select(F.round("lat", 1).alias("average_latency_ms"),
                      F.round(F.when(F.col("q") > 0, F.col("z") / F.col("q") * 100).otherwise(0.0), 2)
                      .alias("zero_result_rate_percent"))


def alert_noise_daily(events: DataFrame, org, as_of: str, false_positive: Column) -> DataFrame:
    daily = (for_tenant(events, org).where(F.col("start_time") >= ago(as_of, days=30))
             .groupBy(F.date_format("start_time", "yyyy-MM-dd").alias("date")).agg(
                 F.count(F.lit(1)).alias("total_alerts"), F.count_if(false_positive).alias("false_positives")))
    return daily.select("date", "total_alerts", "false_positives",
                        (F.col("total_alerts") - F.col("false_positives")).alias("true_positives"),
                        F.round(F.col("false_positives") / F.col("total_alerts") * 100, 1).alias("noise_ratio_percent"))


def alert_fatigue(daily: DataFrame) -> DataFrame:
    index = daily.agg(F.sum("false_positives").alias("fp"), F.sum("total_alerts").alias("n")).select(
        (F.col("fp") / F.col("n") * 100).alias("i"))
    return index.select(F.round("i", 1).alias("average_noise_ratio_percent"),
                        F.when(F.col("i") < 15, "low").when(F.col("i") < 30, "moderate")
                        .when(F.col("i").isNotNull(), "critical").alias("alert_fatigue_status"))


def exact_percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated percentiles without gathering a group in one place.

    A mergeable sketch per group bounds every percentile from both sides, whatever the distribution. One
    pass counts the rows below the bounds and, value by value, those between them; only the latter, a
    share of about ``4 / accuracy`` besides ties, are ordered. One row per ``by`` with a column per point.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    sides = [max(0.0, min(1.0, p + d)) for p in points.values() for d in (-margin, margin)]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("_v", sides, accuracy).alias("_q"), F.count(F.lit(1)).alias("_all"))
    # A margin must span a few ranks, so groups of few rows are ordered whole.
    few = F.col("_all") <= 4 * accuracy
    low, high = (lambda i, d=d, end=end: F.when(few, F.lit(end)).otherwise(F.get("_q", F.lit(2 * i + d))) for d, end in ((0, float("-inf")), (1, float("inf"))))
    near = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(p).alias("p"), low(i).alias("low"), high(i).alias("high"))
                     for i, (n, p) in enumerate(points.items())])
    each = rows.join(sketch, by).select(*by, "_all", "_v", F.explode(near).alias("w")).where("_v <= w.high")
    # Rows below the lower bound share one null value, which comes first.
    counts = each.groupBy(*by, "w.point", "w.p", "_all", F.expr("IF(_v >= w.low, _v, NULL)").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*by, "point").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("p") * (F.col("_all") - 1)
    placed = counts.withColumn("_to", F.sum("_n").over(along)).where("_v IS NOT NULL").withColumns({"_at": at, "_from": F.col("_to") - F.col("_n")})

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_from")) & (rank < F.col("_to"))

    found = placed.groupBy(*by, "point").agg(
        F.max(F.when(holds(F.floor("_at")), F.col("_v"))).alias("a"), F.max(F.when(holds(F.ceil("_at")), F.col("_v"))).alias("b"),
        F.max(F.col("_at") - F.floor("_at")).alias("share"))
    value_of = F.col("a") + (F.col("b") - F.col("a")) * F.col("share")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("point") == n, value_of)).alias(n) for n in points])


def latency_profile(df: DataFrame, latency: str, by: list[str]) -> DataFrame:
    """Mean and interpolated percentiles, and rows per second of busy time."""
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean"), F.sum(latency).alias("_s"))
    points = exact_percentiles(df, by, latency, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return base.join(points, by).select(
        *by, "n", F.round("mean", 6).alias("mean_ms"), *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")],
        F.round(F.col("n") / F.col("_s") * 1000, 6).alias("per_second"))
