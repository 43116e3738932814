"""Structured Streaming: tallies and windowed counts over an attempts stream. The same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attempts_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files that arrive in ``folder``."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def _watermark(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark (times without a zone are taken in the session's); a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and passes by type and tumbling window. On a stream, state older than ``late`` behind the newest event is dropped."""
    marked = _watermark(events, late)
    g = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") >= 50).alias("passes"))
    return g.select(F.col("w.start").alias("start"), "event_type", "events", "passes")


def once(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each event once; on a stream, repeats within ``late`` are dropped with bounded state."""
    return _watermark(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user: events no farther apart than ``gap``."""
    marked = _watermark(events, late)
    g = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
