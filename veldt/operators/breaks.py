"""Hinge breaks: for every candidate year the gain in fit, read off centred hinges that all cells share.

With the intercept and the slope projected out of the hinge at a candidate, the drop in the sum of squares is
(y . h)^2 / (h . h). The projected hinges are a small table of candidate x year, so a fit is one join on the
year and one aggregation: no design matrix is built for a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.operators.ranges import count_at_least


def hinges(spark: SparkSession, first: int, last: int, margin: int) -> DataFrame:
    """tau, t, h, hh, proj: projected hinges for candidates first + margin - 1 ... last - margin, for full series."""
    import numpy as np

    t = np.arange(first, last + 1, dtype=float)
    x = np.stack([np.ones_like(t), t - t.mean()], axis=1)
    rows = []
    for tau in range(first + margin - 1, last - margin + 1):
        raw = np.maximum(0.0, t - tau)
        coef = np.linalg.lstsq(x, raw, rcond=None)[0]
        h = raw - x @ coef
        rows += [(int(tau), int(year), float(v), float(h @ h), float(coef[1])) for year, v in zip(t, h, strict=True)]
    return spark.createDataFrame(rows, "tau int, t int, h double, hh double, proj double")


def hinge_fits(series: DataFrame, first: int, last: int, margin: int = 5) -> DataFrame:
    """cell, sse0, tau, sse1, supf, slope_before, slope_after, direction_ok, tie_count of complete series; the earliest tau wins ties."""
    spark = series.sparkSession
    n, eps = last - first + 1, 2.220446049250313e-16
    cell = Window.partitionBy("cell")
    x = F.col("t") - (first + last) / 2
    full = series.filter(F.col("t").between(first, last) & F.col("v").isNotNull())
    fitted = full.withColumn("n", F.count("v").over(cell)).withColumn("b", F.regr_slope("v", x).over(cell)).withColumn("mean", F.avg("v").over(cell)).withColumn("top", F.max(F.abs("v")).over(cell)).filter(F.col("n") == n)
    rest = fitted.select("cell", "t", "b", "top", (F.col("v") - F.col("mean")).alias("dev"), (F.col("v") - F.col("mean") - F.col("b") * x).alias("r"))
    r, h = F.col("r"), F.col("h")
    dots = rest.join(F.broadcast(hinges(spark, first, last, margin)), "t").groupBy("cell", "tau").agg(F.sum(r * h).alias("yh"), F.sum(r * r).alias("sse0"), F.sum(F.col("dev") * F.col("dev")).alias("syy"), F.first("hh").alias("hh"), F.first("proj").alias("proj"), F.first("b").alias("b"), F.first("top").alias("top"))
    fits = dots.withColumn("tol", F.greatest(100 * eps * F.col("syy"), n * F.pow(eps * F.greatest(F.lit(1.0), "top"), F.lit(2)) * 1000, F.lit(2.2250738585072014e-308)))
    fits = fits.withColumn("sse1", F.greatest(F.lit(0.0), F.col("sse0") - F.col("yh") * F.col("yh") / F.col("hh"))).withColumn("step", F.col("yh") / F.col("hh"))
    tied = fits.withColumn("best", F.min("sse1").over(cell)).filter(F.col("sse1") <= F.col("best") + F.col("tol"))
    pick = tied.groupBy("cell").agg(F.min_by(F.struct("tau", "sse1", "sse0", "tol", "step", "b", "proj"), "tau").alias("x"), F.count(F.lit(1)).alias("tie_count"))
    out = pick.select("cell", "x.*", "tie_count").withColumn("slope_before", F.col("b") - F.col("step") * F.col("proj")).withColumn("slope_after", F.col("slope_before") + F.col("step"))
    supf = F.when(F.col("sse0") <= F.col("tol"), F.lit(0.0)).when(F.col("sse1") <= F.col("tol"), F.lit(float("inf"))).otherwise((n - 3) * (F.col("sse0") - F.col("sse1")) / F.col("sse1"))
    status = F.when(F.col("sse0") <= F.col("tol"), "perfect_linear").when(F.col("sse1") <= F.col("tol"), "exact_hinge").otherwise("normal")
    return out.select("cell", "tau", "sse0", "sse1", supf.alias("supf"), status.alias("status"), "slope_before", "slope_after", ((F.col("slope_before") < -1e-12) & (F.col("slope_after") > 1e-12)).alias("direction_ok"), "tie_count")


def exceedance(observed: DataFrame, null: DataFrame, draws: int) -> DataFrame:
    """observed (cell, stat) with k = #{null >= stat} and p = (1 + k) / (draws + 1); a null stat has neither.

    Both sides are counted by value and ranked together by ranges, so draws and cells may be of any number.
    """
    k = count_at_least(observed.select("cell", "stat"), null.select("stat"))
    return k.select("cell", "stat", F.col("k").cast("long").alias("k"), ((1 + F.col("k")) / F.lit(float(draws + 1))).alias("p"))


def hinge_residuals(series: DataFrame, fits: DataFrame, first: int, last: int, margin: int = 5) -> DataFrame:
    """cell, t, v, fitted, resid of the fitted hinges: the residuals of a line, less the step times the projected hinge."""
    x = F.col("t") - (first + last) / 2
    cell = Window.partitionBy("cell")
    rest = F.col("v") - F.avg("v").over(cell) - F.regr_slope("v", x).over(cell) * x
    line = series.select("cell", "t", "v").withColumn("r", rest).join(fits.select("cell", "tau", (F.col("slope_after") - F.col("slope_before")).alias("step")), "cell")
    h = hinges(series.sparkSession, first, last, margin).select("tau", "t", "h")
    resid = F.col("r") - F.col("step") * F.col("h")
    return line.join(F.broadcast(h), ["tau", "t"]).select("cell", "t", "v", (F.col("v") - resid).alias("fitted"), resid.alias("resid"))
