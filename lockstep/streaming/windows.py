"""The batch windows as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """``events`` with a watermark on ts; a stream's watermark needs a time with a zone, and takes the session's."""
    return (events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by event_type in tumbling windows; works on a batch or a stream."""
    return _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with gaps under ``gap``."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key])
