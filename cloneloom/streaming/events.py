"""Counts over streams of events, an extension: event-time windows with watermarks, and repertoires kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema=None, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_usage(events: DataFrame, key: str = "event_type", ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "2 hours", value: str = "value") -> DataFrame:
    """Per window and key: rows, summed and mean value. Works on streams and tables; state goes once the watermark has
    passed a window."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return e.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean")


def sessions(events: DataFrame, by: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
