"""The change feed as a stream, and streams over readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.plans.service import AnalyticsService
from gridloom.schemas import EVENTS


def read_feed(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Change events as files of them arrive in a folder."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def feed_batches(feed: DataFrame, handle: Callable[[DataFrame, int], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each batch of a stream to `handle`; a batch is repeated with the same number after a failure. `once`: until the feed is read."""

    def run(batch: DataFrame, number: int) -> None:
        handle(batch, number)

    writer = feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_triggered(feed: DataFrame, service: AnalyticsService, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Programs run on the changes of a feed."""
    return feed_batches(feed, lambda batch, _: service.on_events(batch), checkpoint, once)


def windowed(readings: DataFrame, ts: str, length: str, late: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Count, sum and mean of a value per key and window of event time; readings later than `late` are dropped in append mode."""
    at = readings.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    w = F.window("at", length, slide) if slide else F.window("at", length)
    return at.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total", "mean")


def sessions(readings: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of a key: readings no farther apart than `gap`."""
    at = readings.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return at.groupBy(*keys, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")
