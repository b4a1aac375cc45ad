"""Quantile regression forests: the leaves of any forest as a narrow table, weights by an equi-join on the leaf.

A row's forecast distribution is the mean over trees of the training values in its leaf. Trees are data here, rows
(tree, leaf), so nothing is collected: training values are counted by leaf and value, rows that fall into the same
leaves of all trees are one profile, and a profile's distribution is a join, an aggregation and a running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A running weight this close below a quantile's share reaches it.
TOUCH = 1e-9


def leaf_rows(df: DataFrame, model, features: list[str], keep: list[str]) -> DataFrame:
    """keep, tree, leaf: where a fitted tree ensemble puts each row of df; one row a tree."""
    return leaf_lists(df, model, features, keep).select(*keep, F.posexplode("leaves").alias("tree", "leaf"))


def leaf_lists(df: DataFrame, model, features: list[str], keep: list[str]) -> DataFrame:
    """keep, leaves: the leaves of each row of df in tree order, one row a row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    held = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip").transform(df)
    placed = model.setFeaturesCol("__features").setLeafCol("__leaf").setPredictionCol("__p").transform(held)
    return placed.select(*keep, vector_to_array("__leaf").cast("array<bigint>").alias("leaves"))


def fit_forest(train: DataFrame, features: list[str], y: str, trees: int = 100, depth: int = 12, least: int = 10, share: float = 0.65, seed: int = 7):
    """A random forest on all rows: ``least`` rows a leaf, a third of the features tried at a split."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    held = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip").transform(train.filter(F.col(y).isNotNull()))
    forest = RandomForestRegressor(featuresCol="__features", labelCol=y, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=share, featureSubsetStrategy="onethird", seed=seed)
    return forest.fit(held)


def leaf_values(leaves: DataFrame, y: str, n: str | None = None) -> DataFrame:
    """tree, leaf, y, w: the share of each training value in its leaf; w sums to 1 a leaf. Null values take no part.

    n: a column that says how many training rows a row stands for.
    """
    counts = leaves.filter(F.col(y).isNotNull()).groupBy("tree", "leaf", F.col(y).cast("double").alias("y")).agg(F.sum(n or F.lit(1)).alias("k"))
    sizes = counts.groupBy("tree", "leaf").agg(F.sum("k").alias("n"))
    return counts.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "y", (F.col("k") / F.col("n")).alias("w"))


def profiles(leaves: DataFrame, key: list[str]) -> DataFrame:
    """key, profile: rows with equal leaves in every tree share a profile (128 bits of their leaves' hashes)."""
    spot = [F.sum(F.xxhash64(F.lit(i), "tree", "leaf").cast("decimal(38,0)")) for i in (1, 2)]
    return leaves.groupBy(*key).agg(F.md5(F.concat_ws("|", *[s.cast("string") for s in spot], F.count(F.lit(1)).cast("string"))).alias("profile"))


def quantiles(train: DataFrame, rows: DataFrame, key: list[str], y: str, shares: dict[str, float]) -> DataFrame:
    """key, mean and a column for each of shares: a forest's forecast for every row of rows (key, tree, leaf).

    train has (tree, leaf, y) for the rows that a tree was grown on, or for all. A quantile is the least value
    at which the running weight reaches its share of the whole. A leaf without training values counts for nothing; a
    row that meets none has nulls. Each row of rows must have one leaf a tree; a repeated key is one row.
    """
    named = profiles(rows, key)
    alike = rows.join(named, key).select("profile", "tree", "leaf").distinct()
    return named.join(spread_of(alike, leaf_values(train, y), shares), "profile", "left").drop("profile")


def spread_of(alike: DataFrame, values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """profile, mean and a column for each of shares, of profiles (profile, tree, leaf) that meet a training value."""
    spread = alike.join(values, ["tree", "leaf"]).groupBy("profile", "y").agg(F.sum("w").alias("w"))
    whole = Window.partitionBy("profile")
    spread = spread.withColumn("total", F.sum("w").over(whole)).withColumn("upto", F.sum("w").over(whole.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = [F.min(F.when(F.col("upto") >= F.col("total") * s - TOUCH, F.col("y"))).alias(n) for n, s in shares.items()]
    return spread.groupBy("profile").agg((F.sum(F.col("w") * F.col("y")) / F.first("total")).alias("mean"), *wanted)


def quantiles_of_lists(train: DataFrame, rows: DataFrame, y: str, shares: dict[str, float], n: str | None = None) -> DataFrame:
    """rows without ``leaves``, with mean and shares as from quantiles(); leaves is the array of a row's leaves in tree order.

    Equal arrays are one profile, so rows are neither repeated by tree nor grouped: they meet the profiles' forecasts by a join.
    """
    alike = rows.select("leaves").distinct().select(F.col("leaves").alias("profile"), F.posexplode("leaves").alias("tree", "leaf"))
    found = spread_of(alike, leaf_values(train, y, n), shares)
    return rows.join(found, rows["leaves"] == found["profile"], "left").drop("leaves", "profile")


def pinball(df: DataFrame, y: str, quantile: str, share: float):
    """The mean pinball loss of one forecast quantile, as an aggregate column."""
    e = F.col(y) - F.col(quantile)
    return F.avg(F.when(e >= 0, share * e).otherwise((share - 1) * e))
