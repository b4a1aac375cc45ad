"""The calibrated null of a break test: keyed AR(1) series as a table, residual autocorrelation and its bias, isotonic maps.

Noise depends on its key alone (tag, draw, step), so a null is the same for any number of tasks, and SQL can say it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import draw
from veldt.operators.breaks import hinge_fits, hinge_residuals
from veldt.operators.calibrate import apply_map


def noise(tag: str, number: Column, step: Column) -> Column:
    """A standard normal value by its key."""
    u = [(draw(tag, number, step.cast("string"), F.lit(str(j))) + 0.5) / 4294967296.0 for j in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(F.lit(2 * math.pi) * u[1])


def ar1_series(draws: DataFrame, first: int, last: int, tag: str) -> DataFrame:
    """draws (its columns, among them draw and rho) with t and v: stationary AR(1) series of marginal deviation 1.

    Equal draws share their noise, whatever their rho. A series is built in its row; only then it becomes rows.
    """
    steps = F.sequence(F.lit(1), F.lit(last - first + 1))
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, t: Column) -> Column:
        e = noise(tag, F.col("draw"), t)
        v = F.when(t == 1, e).otherwise(F.col("rho") * acc["last"] + F.sqrt(1 - F.col("rho") * F.col("rho")) * e)
        return F.struct(v.alias("last"), F.concat(acc["all"], F.array(v)).alias("all"))

    made = draws.withColumn("__v", F.aggregate(steps, start, step, lambda acc: acc["all"]))
    out = made.select(*draws.columns, F.posexplode("__v").alias("__i", "v"))
    return out.select(*draws.columns, (F.col("__i") + first).alias("t"), "v")


def lag1_of_residuals(series: DataFrame, by: list[str]) -> DataFrame:
    """by, rho: the lag-1 correlation of the residuals of a straight line; null where they have no variance."""
    c = Window.partitionBy(*by)
    e = F.col("v") - F.regr_intercept("v", "t").over(c) - F.regr_slope("v", "t").over(c) * F.col("t")
    return lag1(series.select(*by, "t", e.alias("resid")), by)


def isotonic(table: DataFrame, x: str, y: str) -> DataFrame:
    """table with iso: the non-decreasing fit to y in the order of x, least squares, equal weights.

    The fit at a place is the largest, over starts before it, of the least mean of any stretch from there that
    reaches the place: the min-max form of pooling adjacent violators. For tables of a bounded number of rows (a
    grid); pairs of rows are formed.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(x)
    cum = table.select(F.col(x).alias("__x"), F.col(y).alias("__y")).withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__x")), "cs": F.sum("__y").over(Window.partitionBy(F.lit(1)).orderBy("__x"))})
    a, b = cum.select(F.col("i").alias("a"), F.col("cs").alias("ca"), F.col("__y").alias("ya")), cum.select(F.col("i").alias("b"), F.col("cs").alias("cb"))
    means = a.join(b, F.col("a") <= F.col("b")).withColumn("m", (F.col("cb") - F.col("ca") + F.col("ya")) / (F.col("b") - F.col("a") + 1))
    least = means.withColumn("m", F.min("m").over(Window.partitionBy("a").orderBy(F.desc("b"))))
    iso = least.groupBy(F.col("b").alias("__i")).agg(F.max("m").alias("iso"))
    return table.withColumn("__i", F.row_number().over(w)).join(iso, "__i").drop("__i")


def lag1(residuals: DataFrame, by: list[str], e: str = "resid") -> DataFrame:
    """by, rho: the lag-1 correlation of residuals that are given."""
    r = residuals.select(*by, F.col(e).alias("e"), F.lead(e).over(Window.partitionBy(*by).orderBy("t")).alias("f")).filter("f is not null")
    below = F.sqrt(F.sum(F.col("e") * F.col("e")) * F.sum(F.col("f") * F.col("f")))
    return r.groupBy(*by).agg(F.when(below > 0, F.sum(F.col("e") * F.col("f")) / below).alias("rho"))


def bias_map(spark, grid: list[float], draws: int, first: int, last: int, tag: str = "bias", margin: int | None = None) -> DataFrame:
    """true_rho, estimated, iso: what the residuals of known series say of their rho (median over draws), made monotone.

    Residuals are those of a line, or of the best hinge at ``margin`` if one is given.
    """
    known = spark.createDataFrame([(i, r) for i, r in enumerate(grid)], "g int, rho double")
    number = spark.range(1, draws + 1).select(F.col("id").alias("draw"))
    series = ar1_series(number.crossJoin(F.broadcast(known)), first, last, tag)
    series = series.select((F.col("g") * F.lit(draws + 1) + F.col("draw")).alias("cell"), F.col("rho").alias("true_rho"), "t", "v")
    if margin is None:
        seen = lag1_of_residuals(series, ["true_rho", "cell"])
    else:
        rest = hinge_residuals(series.select("cell", "t", "v"), hinge_fits(series.select("cell", "t", "v"), first, last, margin), first, last, margin)
        seen = lag1(rest, ["cell"]).join(F.broadcast(known.select("g", F.col("rho").alias("true_rho"))), F.floor(F.col("cell") / (draws + 1)) == F.col("g"))
    middle = seen.groupBy("true_rho").agg(F.median("rho").alias("estimated"))
    return isotonic(middle, "true_rho", "estimated")


def correct_rho(raw: DataFrame, mapping: DataFrame, most: float = 0.95) -> DataFrame:
    """raw (rho) with corrected: the true value whose estimate is rho; plateaus of the map count once, by their median."""
    once = mapping.groupBy(F.col("iso").alias("x")).agg(F.median("true_rho").alias("y"))
    up = Window.partitionBy(F.lit(1)).orderBy("x")  # a grid's rows
    knots = once.select("x", "y", F.lead("x").over(up).alias("x1"), F.lead("y").over(up).alias("y1"))
    clip = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("mapped")))
    return apply_map(raw, "rho", knots).withColumn("corrected", clip).drop("mapped")
