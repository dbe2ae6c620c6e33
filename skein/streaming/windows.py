"""Windowed counts of events, alike in batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, minutes: int, late: str | None = None) -> DataFrame:
    """Events and their summed value per window and type. late: watermark, for streams."""
    timed = events.withWatermark("ts", late) if late else events
    found = timed.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n_events"), F.sum("cents").alias("cents"))
    return found.select(F.col("window.start").alias("started"), "event_type", "n_events", "cents")


def sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    found = events.groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes")).agg(F.count("*").alias("n_events"), F.min("ts").alias("began"))
    return found.select("user_id", "began", "n_events")
