"""Rollups kept current by windowed aggregation; rows later than ``lateness`` make a drain fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilgrid.session import cut_lineage

LATENESS = "2 hours"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
PARTS_SETTING = "spark.sql.shuffle.partitions"
UNLOAD_SETTING = "spark.sql.streaming.stateStore.unloadOnCommit"
#: State partitions that a stream with a store of its own keeps at least, if the session has as many.
FEWEST_PARTS = 8


def _bucketed(df: DataFrame, ts: str, width: str, lateness: str, keys: list[str], *aggs) -> DataFrame:
    out = df.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"])


def events_hourly(events: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return _bucketed(events, ts, "1 hour", lateness, ["org_id", "camera_id", "event_type", "severity"], F.count(F.lit(1)).alias("event_count"))


def searches_hourly(searches: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return _bucketed(searches, ts, "1 hour", lateness, ["org_id"], F.count(F.lit(1)).alias("query_count"), F.avg("latency_ms").alias("avg_latency_ms"),
                     F.count_if(F.col("results_count") == 0).alias("zero_results_count"))


def detections_daily(detections: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return _bucketed(detections, ts, "1 day", lateness, ["org_id", "class_label"], F.count(F.lit(1)).alias("object_count"))


def health_hourly(health: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return _bucketed(health, ts, "1 hour", lateness, ["org_id", "camera_id"],
                     F.avg(F.when(F.col("uptime_status") == "online", 1.0).otherwise(0.0)).alias("uptime_ratio"),
                     F.avg("frame_drop_rate").alias("avg_frame_drop_rate"), F.avg("detection_latency_ms").alias("avg_detection_latency_ms"))


def segments(frames: DataFrame, ts: str = "ts", length_s: int = 30, overlap_s: int = 2, lateness: str = LATENESS) -> DataFrame:
    """Overlapping capture segments, the streaming form of ``plans.ingest.segments``."""
    w = F.window(ts, f"{length_s} seconds", f"{length_s - overlap_s} seconds")
    out = frames.withWatermark(ts, lateness).groupBy("camera_id", w.alias("w")).agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("frames"))
    return out.select("camera_id", F.col("w.start").alias("start_time"), "first_ms", "last_ms", "frames")


def dwell_sessions(tracks: DataFrame, gap: str, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Sessions of a track separated by ``gap``, with their dwell in seconds."""
    out = tracks.withWatermark(ts, lateness).groupBy("camera_id", "track_id", F.session_window(ts, gap).alias("s")).agg(
        F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))
    return out.select("camera_id", "track_id", "first_seen", "last_seen", ((F.col("last_seen") - F.col("first_seen")) / 1000.0).alias("dwell_s"))


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append", store: str | None = None) -> None:
    """Drain what is available into Parquet files under ``path``; exactly once through the checkpoint.

    ``store`` names the state store of this stream alone; a stream takes its settings when it starts.
    Each operator of such a stream opens and commits a store per partition in every micro-batch, however
    few its rows, and nothing merges small ones; so it takes no more partitions than there are cores.
    Its stores close as their tasks end: left open they hold files and threads until a maintenance some
    time after the stream, and a few streams in a row pass a process's limit of open files.
    """
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    spark = df.sparkSession
    own = {} if store is None else {STORE_SETTING: store, PARTS_SETTING: str(_parts(spark)), UNLOAD_SETTING: "true"}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        query = writer.start(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    drained(query)


def _parts(spark: SparkSession) -> int:
    return min(int(spark.conf.get(PARTS_SETTING)), max(FEWEST_PARTS, spark.sparkContext.defaultParallelism))


def drained(query: StreamingQuery) -> None:
    """Wait for a query that stops by itself; fails if the watermark made it drop rows."""
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if late:
        raise RuntimeError(f"{late} rows came later than the watermark allows and are missing; allow more lateness or feed files in event-time order")


def searches_by_second(searches: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return _bucketed(searches, ts, "1 second", lateness, ["org_id"], F.count(F.lit(1)).alias("query_count"))


class KeptTable:
    """A rollup kept current in a table whose files stay few, however many micro-batches write it.

    Rows lie by day of their bucket. A micro-batch rewrites the days that it changes, rows it does not
    change included, as a new version of each day; readers take a day's newest version. The version
    before stays for readers that have begun, older ones go. Writing a micro-batch again replaces its versions.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], bucket: str = "bucket", files_per_day: int = 1):
        self.spark, self.folder, self.keys, self.bucket, self.files_per_day = spark, folder, list(keys), bucket, files_per_day

    def _versions(self, before: int | None = None) -> DataFrame | None:
        """Rows of every day's newest version, of micro-batches before the given one."""
        if not _there(self.spark, self.folder):
            return None
        rows = self.spark.read.option("basePath", self.folder).parquet(f"{self.folder}/day=*")
        if before is not None:
            rows = rows.where(F.col("version") < before)
        newest = F.broadcast(rows.groupBy("day").agg(F.max("version").alias("version")))  # a row per day
        return rows.join(newest, ["day", "version"])

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Take the changed groups of a micro-batch, each with its whole new value."""
        changed = cut_lineage(changed.withColumn("day", F.date_format(self.bucket, "yyyy-MM-dd")))
        days = [r.day for r in changed.select("day").distinct().collect()]
        if not days:
            return
        rows, held = changed, self._versions(batch_id)
        if held is not None:
            same = [self.bucket, *self.keys]
            rest = held.where(F.col("day").cast("string").isin(days)).withColumn("day", F.col("day").cast("string")).drop("version")
            rows = rest.join(changed.select(*same), same, "left_anti").unionByName(changed)
        # Counted before its old version could go, so nothing is read from what it replaces.
        rows = cut_lineage(rows.withColumn("version", F.lit(batch_id)))
        rows.repartition(self.files_per_day * len(days), "day").write.partitionBy("day", "version").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(self.folder)
        self._forget(days)

    def _forget(self, days: list[str]) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for day in days:
            at = path(f"{self.folder}/day={day}")
            files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            found = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in files.listStatus(at) if "version=" in s.getPath().getName())
            for _, old in found[:-2]:
                files.delete(old, True)

    def rows(self) -> DataFrame:
        """The table as it stands; before the first rows have come there is none."""
        held = self._versions()
        if held is None:
            raise FileNotFoundError(f"nothing has been kept in {self.folder} yet")
        return held.drop("day", "version")

    def keep(self, rollup: DataFrame, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
        """Keep an update-mode rollup; ``every=None`` takes what is available and stops."""
        writer = rollup.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(self.write)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def _there(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/day=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def upsert_latest(df: DataFrame, folder: str, checkpoint: str, every: str | None = "5 seconds"):
    """Update-mode feed: each micro-batch's changed groups go to their own folder ``batch=N``.

    Writing a batch again after a failure overwrites that folder, so readers never see it twice.
    ``every=None`` drains what is available and stops.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
