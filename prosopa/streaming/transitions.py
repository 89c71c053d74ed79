"""Counts of events in windows of time, over streams with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind in each window of time; rows later than `late` are dropped by the watermark.
    Works on streams and, without the watermark's effect, on tables."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    seen = timed.withWatermark("_t", late) if events.isStreaming else timed
    counted = seen.groupBy(F.window("_t", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "events")
