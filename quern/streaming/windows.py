"""Windowed counts, the same over a batch and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by tumbling window and kind; over a stream, late rows within ``late`` still count."""
    events = events.withWatermark(time, late) if events.isStreaming else events
    grouped = events.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), kind, "n")
