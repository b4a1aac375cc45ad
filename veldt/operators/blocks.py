"""Block bootstraps: keyed weights times sufficient statistics, never resampled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from veldt.functions.scalars import draw


def weights(blocks: DataFrame, unit: list[str], replicates: int, seed: int) -> DataFrame:
    """unit, rep, block, w: how often each of a unit's blocks is drawn when as many are drawn as there are.

    blocks: distinct (unit, block). Draw ``slot`` of replicate ``rep`` depends on (seed, rep, slot) and the number
    of blocks alone.
    """
    whole = Window.partitionBy(*unit)
    ranked = blocks.withColumn("place", F.row_number().over(whole.orderBy("block")) - 1).withColumn("size", F.count(F.lit(1)).over(whole))
    reps = F.sequence(F.lit(1), F.lit(replicates))
    slots = ranked.select(*unit, F.col("place").alias("slot"), "size", F.explode(reps).alias("rep"))
    drawn = slots.withColumn("place", F.pmod(draw(seed, F.col("rep"), F.col("slot")), F.col("size")).cast("int"))
    counted = drawn.groupBy(*unit, "rep", "place").agg(F.count(F.lit(1)).alias("w"))
    return counted.join(ranked.select(*unit, "place", "block"), [*unit, "place"]).select(*unit, "rep", "block", "w")


def replicate_sums(stats: DataFrame, drawn: DataFrame, unit: list[str], keys: list[str], sums: list[str]) -> DataFrame:
    """unit, rep, keys, and the weighted sums of stats (unit, block, keys, sums)."""
    return stats.join(drawn, [*unit, "block"]).groupBy(*unit, "rep", *keys).agg(*[F.sum(F.col("w") * F.col(s)).alias(s) for s in sums])


def interval(v: str, level: float = 0.95) -> list[Column]:
    """low, median and high percentile columns."""
    a = (1 - level) / 2
    return [F.percentile(v, a).alias("low"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 1 - a).alias("high")]


def plus_one_p(v: Column, est: Column) -> Column:
    """Two-sided p of replicates around their estimate."""
    return (1 + F.sum(F.when(F.abs(v - est) >= F.abs(est), 1).otherwise(0))) / (1 + F.count(v))


def scenario_grid(spark: SparkSession, name: str, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")
