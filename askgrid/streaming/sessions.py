"""Structured Streaming over the event and trace logs: windows with a watermark, sessions by a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timely(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark; times without a zone are the session's."""
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, mean) of each window; works on a stream and on a table alike, late rows being dropped on a stream."""
    rows = _timely(events, time, late)
    return rows.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), kind, "n", "mean")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n): runs of events with no gap longer than ``gap``."""
    rows = _timely(events, time, late)
    out = rows.groupBy(user, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
