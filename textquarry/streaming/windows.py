"""Windows over events, for batches and streams alike (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need times with a zone: those without are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(window, event_type, n) in tumbling hours; on a stream, events up to ``late`` late still count."""
    return _timed(events, late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(session_window, user_id, n): runs of a user's events without a longer gap."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
