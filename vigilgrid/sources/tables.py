"""Typed scans and batch sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilgrid.operators.filters import for_tenant
from vigilgrid.sources.schemas import COLLECTIONS, TABLES


def scan(spark: SparkSession, root: str, name: str, org=None, tenant: bool = False) -> DataFrame:
    """A domain table with its fixed schema; ``tenant`` applies the organisation filter."""
    df = spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
    return for_tenant(df, org) if tenant else df


def scan_jdbc(spark: SparkSession, url: str, name: str, partition_column: str, lower, upper, parts: int = 64,
              **options: str) -> DataFrame:
    """The same table from a relational database, read in ``parts`` ranges of one column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    reader = reader.option("partitionColumn", partition_column).option("lowerBound", lower)
    return reader.option("upperBound", upper).option("numPartitions", parts).options(**options).load()


def scan_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(COLLECTIONS[name]).parquet(f"{root.rstrip('/')}/{name}")


def month_of(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def segment_key(org: str, camera: str, start: str, segment: str) -> Column:
    """Object key org/camera/YYYY/MM/DD/id.mp4."""
    return F.concat_ws("/", F.col(org), F.col(camera), F.date_format(start, "yyyy/MM/dd"),
                       F.concat(F.col(segment).cast("string"), F.lit(".mp4")))


def register_segments(segments: DataFrame, path: str, mode: str = "append") -> None:
    """Append segments with their object key, partitioned by month of start.

    Rows are first gathered by month, so a month is written by few tasks and yields few files;
    rebalancing splits a month that is too large for one task.
    """
    keyed = segments.withColumn("s3_key", segment_key("org_id", "camera_id", "start_time", "segment_id")).withColumn(
        "month", month_of("start_time"))
    keyed.hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def segments_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Segments by start time; the month bound lets Spark skip whole partitions."""
    df = spark.read.parquet(path)
    lo, hi = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))
    return df.where(F.col("month").cast("string").between(start[:7], end[:7]) & F.col("start_time").between(lo, hi))


def write_collection(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vector table laid out by camera; a large camera is split over several files."""
    vectors.hint("rebalance", "camera_id").write.mode(mode).partitionBy("camera_id").parquet(path)


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """The rows as a table of ``buckets`` files by a hash of ``key``, read back so that joins and groups on the key need no exchange.

    Choose a key with many values, such as the segment rather than its camera, so that no bucket holds much more than its share.
    """
    name = f"buckets_{path.rstrip('/').rsplit('/', 1)[-1].replace('-', '_')}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def joined_buckets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Merge join of two tables bucketed alike by ``key``: every task reads its bucket of both, nothing is shuffled."""
    return left.join(right.hint("merge"), key)


def publish_version(vectors: DataFrame, root: str, name: str, version: int, ttl_seconds: int = 2_592_000) -> str:
    """Write ``name_vN`` and point the view ``name`` at it; readers see the old or the new version."""
    path = f"{root.rstrip('/')}/{name}_v{version}"
    write_collection(vectors, path)
    vectors.sparkSession.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('collection.version'='{version}', "
        f"'collection.ttl.seconds'='{ttl_seconds}') AS SELECT * FROM parquet.`{path}`")
    return path


def retire(spark: SparkSession, name: str) -> None:
    """Drop the alias. Files of the version stay until retention removes them."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")


def unexpired(vectors: DataFrame, ts_ms: str, ttl_seconds: int, as_of_ms: int) -> DataFrame:
    return vectors.where(F.col(ts_ms) >= as_of_ms - ttl_seconds * 1000)


def frame_records(detections: DataFrame, camera: str, frame: str, ts_ms: str, fields: list[str]) -> DataFrame:
    """One record per frame with its detections nested, as the line format asks."""
    return detections.groupBy(F.col(camera).alias("camera_id"), F.col(frame).alias("frame_id")).agg(
        F.round(F.min(ts_ms), 2).alias("timestamp_ms"), F.array_sort(F.collect_list(F.struct(*fields))).alias("detections"))


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines: frame metadata, audit records, metric reports."""
    df.write.mode(mode).json(path)


def flat_columns(df: DataFrame) -> list[str]:
    """Sorted names of the columns a CSV can hold."""
    return sorted(n for n, t in df.dtypes if not t.startswith(("struct", "map", "array")))


def export_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt.lower() == "csv":
        df.select(*flat_columns(df)).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def crop_manifest(detections: DataFrame, camera: str, track: str, frame: str, label: str, confidence: str) -> DataFrame:
    """Where each crop belongs: camera/track_{id}/{frame}_{label}_{confidence}.jpg."""
    folder = F.coalesce(F.concat(F.lit("track_"), F.col(track).cast("string")), F.lit("untracked"))
    name = F.format_string("%d_%s_%.2f.jpg", F.col(frame), F.col(label), F.col(confidence))
    return detections.withColumn("track", folder).withColumn(
        "crop_path", F.concat_ws("/", F.col(camera).cast("string"), folder, name))
