"""Extension beyond batch profiling: drift and profiles of a stream in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Event times as instants of the session's time zone, as watermarks need them; times without a zone are read in it."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late) if events.isStreaming else events


def windowed_profile(events: DataFrame, ts: str, value: str, width: str = "1 day", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Count, mean, spread and range of a value per window; works on batch frames and streams alike."""
    grouped = _timed(events, ts, late).groupBy(F.window(ts, width), *(by or []))
    stats = grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return stats.select(F.col("window.start").alias("start"), *(by or []), "n", "mean", "std", "lo", "hi")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, n): stretches of a user's events with no pause of ``gap``."""
    out = _timed(events, ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("session_window.start").alias("start"), "n")
