"""The same measures over streams: event-time windows with watermarks. An extension; batch results don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Watermarks need a timestamp with a zone; naive times count as UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def daily_counts(stream: DataFrame, time: str, key: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, day, n) once a day can no longer change."""
    s = with_event_time(stream, time, late)
    keys = [F.col(key)] if key else []
    return s.groupBy(F.window(time, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.to_date("window.start").alias("day"), "n")


def running_stats(stream: DataFrame, time: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, count, mean, std, min, max) per window."""
    s = with_event_time(stream, time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return s.groupBy(w).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), "count", "mean", "std", "min", "max")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events without a longer gap."""
    s = with_event_time(stream, time, late)
    return s.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
