"""Event-time buckets that read the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buckets(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by tumbling windows; on a stream, rows later than ``late`` are let go and state is bounded."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    g = held.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
