"""Event-time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.queries import query
from veldt.sources.tables import table
from veldt.streaming.events import buckets


@query("events_daily", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def daily(spark, d):
    b = buckets(table(spark, d, "events"))
    return b.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
