"""Order statistics over a whole table without a task that holds it: ranks, running sums, suffix minima, quantiles.

Rows are dealt by ranges of their order and sorted within. What a range holds is summed up in one row, these rows
are run over once (as many as there are partitions), and each range then starts from what the others carry to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.sources.shared import cut

PART, AT = "__part", "__at"


def by_ranges(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df dealt by ranges of (by, order), with the number of its range and its place; checkpointed, so that both stay."""
    dealt = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn(AT, F.monotonically_increasing_id())
    return cut(dealt.withColumn(PART, F.shiftright(AT, 33)))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys; null equals null."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def carried(placed: DataFrame, by: list[str], start: DataFrame) -> DataFrame:
    """placed with the columns of start, which has a row for each range and family."""
    right = start.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate([PART, *by])], *[c for c in start.columns if c not in (PART, *by)])
    on = reduce(lambda x, y: x & y, [placed[k].eqNullSafe(right[f"__key{i}"]) for i, k in enumerate([PART, *by])])
    return placed.join(right, on).drop(*[f"__key{i}" for i in range(len(by) + 1)])


def _family(by: list[str]) -> list[Column]:
    return [F.col(k) for k in by] or [F.lit(1)]


def running_sum(placed: DataFrame, by: list[str], value: str, name: str, total: str) -> DataFrame:
    """placed with the sum of value up to each row, in order, and the family's total."""
    local = Window.partitionBy(PART, *by).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    held = placed.groupBy(PART, *by).agg(F.sum(value).alias("__held"))
    family = Window.partitionBy(*_family(by))
    before = F.sum("__held").over(family.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    start = held.select(PART, *by, F.coalesce(before, F.lit(0)).alias("__carry"), F.sum("__held").over(family).alias(total))
    return carried(placed.withColumn(name, F.sum(value).over(local)), by, start).withColumn(name, F.col(name) + F.col("__carry")).drop("__carry")


def suffix_min(placed: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """placed with the least value from each row on, in order."""
    local = Window.partitionBy(PART, *by).orderBy(F.desc(AT)).rowsBetween(Window.unboundedPreceding, 0)
    held = placed.groupBy(PART, *by).agg(F.min(value).alias("__held"))
    after = F.min("__held").over(Window.partitionBy(*_family(by)).orderBy(PART).rowsBetween(1, Window.unboundedFollowing))
    start = held.select(PART, *by, after.alias("__carry"))
    return carried(placed.withColumn(name, F.min(value).over(local)), by, start).withColumn(name, F.least(name, "__carry")).drop("__carry")


def settled(df: DataFrame) -> DataFrame:
    return df.drop(PART, AT)


def count_at_least(observed: DataFrame, reference: DataFrame, value: str = "stat", by: list[str] = ()) -> DataFrame:
    """observed with k, the number of reference rows of its group whose value is not below its own; a null value has a null k.

    Both sides are counted by value, so a value that many rows share is one row of the ranges. observed is checkpointed:
    it is read twice, and a sum taken again in another order would not meet its own value.
    """
    by, observed = list(by), cut(observed)
    both = reference.select(*by, value, F.lit(1).alias("n")).union(observed.select(*by, value, F.lit(0).alias("n"))).filter(F.col(value).isNotNull())
    levels = both.groupBy(*by, value).agg(F.sum("n").alias("n"))
    ranked = running_sum(by_ranges(levels, by, value), by, "n", "upto", "all")
    k = ranked.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(value).alias("__v"), (F.col("all") - F.col("upto") + F.col("n")).alias("k"))
    on = [F.col(value) == F.col("__v"), *[observed[c].eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]]
    return observed.join(k, reduce(lambda x, y: x & y, on), "left").drop("__v", *[f"__k{i}" for i in range(len(by))])


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """by, share, q: exact quantiles by linear interpolation between order statistics (type 7); nulls take no part.

    Only the levels at the two ranks of each share are looked up; groups of any size and values that many rows
    share are fine. A group without values has no row.
    """
    by = list(by)
    levels = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    ranked = running_sum(by_ranges(levels, by, "__v"), by, "__k", "__r", "__n")
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    at = (F.col("__n") - 1) * F.col("share")
    asked = ranked.filter(reduce(lambda x, y: x | y, [(F.col("__r") > F.floor((F.col("__n") - 1) * s)) & (F.col("__r") - F.col("__k") <= F.ceil((F.col("__n") - 1) * s)) for s in shares]))
    asked = asked.select(*by, "__v", "__r", "__k", "__n", wanted).withColumn("__h", at)
    holds = lambda i: (F.col("__r") > i) & (F.col("__r") - F.col("__k") <= i)
    low, high = F.max(F.when(holds(F.floor("__h")), F.col("__v"))), F.max(F.when(holds(F.ceil("__h")), F.col("__v")))
    ends = asked.groupBy(*by, "share").agg(low.alias("__lo"), high.alias("__hi"), F.first("__h").alias("__h"))
    mixed = (F.ceil("__h") - F.col("__h")) * F.col("__lo") + (F.col("__h") - F.floor("__h")) * F.col("__hi")
    return ends.select(*by, "share", F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(mixed).alias("q"))
