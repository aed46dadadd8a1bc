"""Streams of detections, alerts and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilgrid.sources.schemas import FRAME_MESSAGE


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a table, which is a folder or a single file, as they arrive.

    Files that are there at the same trigger form one micro-batch, so their number and order do not
    decide which rows the watermark calls late. With ``files_per_trigger`` a backlog is cut into
    micro-batches by age of the files; these must then hold rows in event-time order, within the lateness.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def frame_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Frame messages as JSON lines."""
    return spark.readStream.schema(FRAME_MESSAGE).json(folder)


def frame_messages(kafka: DataFrame) -> DataFrame:
    """Frame messages from a Kafka-shaped frame with a binary ``value``."""
    return kafka.select(F.from_json(F.col("value").cast("string"), FRAME_MESSAGE).alias("m")).select("m.*")


def detections(frames: DataFrame) -> DataFrame:
    """One row per detection; a frame without any keeps one row with null detection fields."""
    return frames.select("camera_id", "frame_id", "timestamp_ms", F.explode_outer("detections").alias("d")).select(
        "camera_id", "frame_id", "timestamp_ms", "d.track_id", "d.class_id", "d.class_label", "d.confidence", "d.bbox")


def event_time(ts_ms: str | Column) -> Column:
    return F.timestamp_millis(ts_ms)
