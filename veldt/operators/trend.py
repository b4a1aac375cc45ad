"""Sen slope, Mann-Kendall and its correction for autocorrelation, on packed series.

Each cell is one row with its points as an array, so pairs of points never become rows: one shuffle packs the
series, and all statistics are expressions over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.scalars import two_sided


def median_of(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def pair_map(s: Column, f) -> Column:
    """f(earlier, later) for every pair of points, flat."""
    return F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: f(a, b))))


def with_trend(packed: DataFrame) -> DataFrame:
    """Adds n, sen_slope, s_stat, var_s, z, p to (cell, s). Fewer than three points give null statistics."""
    s, n = F.col("s"), F.size("s").cast("double")
    slopes = pair_map(s, lambda a, b: (b["v"] - a["v"]) / (b["t"] - a["t"]))
    signs = pair_map(s, lambda a, b: F.signum(b["v"] - a["v"]))
    values = F.transform(s, lambda x: x["v"])
    ties = F.transform(F.array_distinct(values), lambda u: F.size(F.filter(values, lambda v: v == u)).cast("double"))
    tied = F.aggregate(ties, F.lit(0.0), lambda acc, t: acc + t * (t - 1) * (2 * t + 5))
    out = packed.withColumn("n", F.size("s").cast("long")).withColumn("sen_slope", median_of(slopes)).withColumn("s_stat", F.when(n >= 3, total(signs)))
    out = out.withColumn("var_s", F.when(n >= 3, (n * (n - 1) * (2 * n + 5) - tied) / 18e0))
    return with_p(out, "var_s", "z", "p")


def with_p(df: DataFrame, var: str, z: str, p: str) -> DataFrame:
    """Continuity-corrected z and its two-sided p; no variance gives p = 1 for S = 0, else null."""
    s, v = F.col("s_stat"), F.col(var)
    score = F.when(v > 0, (s - F.signum(s)) / F.sqrt(v))
    return df.withColumn(z, score).withColumn(p, F.when(v > 0, two_sided(score)).when((s == 0) & (v == 0), F.lit(1.0)))


def with_hamed_rao(df: DataFrame, digits: int = 9) -> DataFrame:
    """Adds correction, var_hr, z_hr, p_hr: the variance inflated by the significant autocorrelations of residual ranks."""
    s, n = F.col("s"), F.size("s").cast("double")
    rest = F.transform(s, lambda x: F.round(x["v"] - F.col("sen_slope") * x["t"], digits))
    ranks = F.transform(F.col("rest"), lambda r: F.size(F.filter(F.col("rest"), lambda q: q < r)).cast("double") + (F.size(F.filter(F.col("rest"), lambda q: q == r)).cast("double") + 1) / 2)
    mid = F.transform(F.col("ranks"), lambda r: r - (n + 1) / 2)
    out = df.withColumn("rest", rest).withColumn("ranks", ranks).withColumn("mid", mid)
    c0 = total(F.transform(F.col("mid"), lambda m: m * m))

    def lag(k: Column) -> Column:
        size = F.size("mid") - k
        return total(F.zip_with(F.slice("mid", 1, size), F.slice("mid", k + 1, size), lambda a, b: a * b)) / c0

    lags = F.when((F.size("mid") >= 3) & (c0 > 0), F.transform(F.sequence(F.lit(1), F.size("mid") - 1), lambda k: F.struct(k.cast("double").alias("k"), lag(k).alias("r"))))
    big = F.filter(lags, lambda x: F.abs(x["r"]) > 1.96 / F.sqrt(n))
    extra = F.aggregate(big, F.lit(0.0), lambda acc, x: acc + (n - x["k"]) * (n - x["k"] - 1) * (n - x["k"] - 2) * x["r"])
    out = out.withColumn("correction", F.when(n >= 3, F.greatest(F.lit(1e-6), 1 + 2 / (n * (n - 1) * (n - 2)) * F.coalesce(extra, F.lit(0.0))))).withColumn("var_hr", F.col("var_s") * F.col("correction"))
    return with_p(out, "var_hr", "z_hr", "p_hr").drop("rest", "ranks", "mid")
