"""Hourly and daily rollups; the same expressions serve batch and streaming callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.functions.text import hour_label


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_of(ts: str) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def events_hourly(events: DataFrame, ts: str = "start_time") -> DataFrame:
    return events.groupBy(hour_of(ts).alias("bucket"), "org_id", "camera_id", "event_type", "severity").agg(
        F.count(F.lit(1)).alias("event_count"))


def searches_hourly(searches: DataFrame, ts: str = "created_at") -> DataFrame:
    return searches.groupBy(hour_of(ts).alias("bucket"), "org_id").agg(
        F.count(F.lit(1)).alias("query_count"), F.avg("latency_ms").alias("avg_latency_ms"),
        F.count_if(F.col("results_count") == 0).alias("zero_results_count"))


def detections_daily(detections: DataFrame, ts: str = "created_at") -> DataFrame:
    return detections.groupBy(day_of(ts).alias("bucket"), "org_id", "class_label").agg(
        F.count(F.lit(1)).alias("object_count"))


def health_hourly(health: DataFrame, ts: str = "ts") -> DataFrame:
    return health.groupBy(hour_of(ts).alias("bucket"), "org_id", "camera_id").agg(
        F.avg(F.when(F.col("uptime_status") == "online", 1.0).otherwise(0.0)).alias("uptime_ratio"),
        F.avg("frame_drop_rate").alias("avg_frame_drop_rate"),
        F.avg("detection_latency_ms").alias("avg_detection_latency_ms"))


def by_hour_of_day(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(hour_label(F.hour("bucket")).alias("hour")).agg(
        F.sum("event_count").alias("events"))
