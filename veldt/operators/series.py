"""Cubes of (cell, t, v): completeness, packing into one row a cell, periods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_years(n: Column, share: float = 0.8) -> Column:
    return F.greatest(F.lit(3), F.ceil(n * share)).cast("long")


def complete(series: DataFrame, steps: int | None = None, share: float = 0.8) -> DataFrame:
    """Rows of the cells with at least max(3, ceil(share x steps)) values; steps: the distinct t by default."""
    if steps is None:
        need = series.agg(least_years(F.count_distinct("t"), share).alias("need"))
        full = series.filter("v is not null").groupBy("cell").agg(F.count("v").alias("n")).join(F.broadcast(need), F.col("n") >= F.col("need"))
    else:
        full = series.filter("v is not null").groupBy("cell").agg(F.count("v").alias("n")).filter(F.col("n") >= max(3, math.ceil(steps * share)))
    return series.join(full.select("cell"), "cell", "left_semi")


def pack(series: DataFrame) -> DataFrame:
    """cell, s: its points (t, v) in the order of t. All that follows is local to the row."""
    return series.filter("v is not null").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v")))).alias("s"))


def period_means(series: DataFrame, periods: DataFrame, share: float = 0.8) -> DataFrame:
    """cell, name, mean: over periods (name, t0, t1), null below ceil(share x length) values."""
    near = series.join(F.broadcast(periods), F.col("t").between(F.col("t0"), F.col("t1")))
    need = F.ceil((F.first("t1") - F.first("t0") + 1) * share)
    return near.groupBy("cell", "name").agg(F.when(F.count("v") >= need, F.avg("v")).alias("mean"), F.count("v").alias("n"))
