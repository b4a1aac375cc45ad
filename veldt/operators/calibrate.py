"""Quantile mapping, out-of-domain screening, calibrated filling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators import ranges


def knots(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """x, y, x1, y1: n percentile pairs of two columns, one y an x, monotone, with the next knot beside each."""
    shares = [i / (n - 1) for i in range(n)]
    xs = ranges.quantiles(df, x, shares).select("share", F.col("q").alias("x"))
    ys = ranges.quantiles(df, y, shares).select("share", F.col("q").alias("qy"))
    flat = xs.join(F.broadcast(ys), "share").groupBy("x").agg(F.avg("qy").alias("y"))  # n rows at most
    up = Window.partitionBy(F.lit(1)).orderBy("x")  # n rows at most
    return flat.select("x", F.max("y").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("y")).select("x", "y", F.lead("x").over(up).alias("x1"), F.lead("y").over(up).alias("y1"))


def apply_map(df: DataFrame, p: str, table: DataFrame) -> DataFrame:
    """df with ``mapped``: piecewise linear between knots, flat beyond. The knots travel as one array, searched in place."""
    k = table.agg(F.array_sort(F.collect_list(F.struct("x", "y", "x1", "y1"))).alias("__ks"))
    held = F.filter("__ks", lambda q: q["x"] <= F.col(p))
    joined = df.join(F.broadcast(k)).withColumn("__at", F.get(held, F.size(held) - 1))  # looked up once a row
    at, low = F.col("__at"), F.get(F.col("__ks"), F.lit(0))
    inside = F.when(at["x1"].isNull(), at["y"]).otherwise(at["y"] + (F.col(p) - at["x"]) / (at["x1"] - at["x"]) * (at["y1"] - at["y"]))
    return joined.withColumn("mapped", F.when(F.col(p) < low["x"], low["y"]).otherwise(inside)).drop("__ks", "__at")


def domain(df: DataFrame, cols: list[str], ridge: float = 1e-4) -> dict:
    """Centre, scale, range and inverse covariance of z-scores over the complete rows: p x p sums are all that reaches the driver.

    A column without variance has scale 1; an ill-conditioned covariance gets its pseudo-inverse; fewer than
    max(3, p + 1) complete rows are an error.
    """
    full = df
    for c in cols:
        full = full.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")))
    first = full.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))]).first()
    if first.n < max(3, len(cols) + 1):
        raise ValueError(f"{first.n} complete rows are too few for {len(cols)} predictors")
    m, s, lo, hi = ([first[f"{k}_{c}"] for c in cols] for k in ("m", "s", "lo", "hi"))
    s = [x or 1.0 for x in s]
    z = [(F.col(c) - a) / b for c, a, b in zip(cols, m, s, strict=True)]
    cov = full.agg(*[F.covar_samp(z[i], z[j]).alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]).first()
    whole = np.array([[cov[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))]) + ridge * np.eye(len(cols))
    return {"cols": cols, "centre": m, "scale": s, "low": lo, "high": hi, "inverse": np.linalg.pinv(whole) if np.linalg.cond(whole) > 1e8 else np.linalg.inv(whole)}


def distance(ref: dict):
    """Squared Mahalanobis distance as a column expression."""
    z = [(F.col(c) - m) / s for c, m, s in zip(ref["cols"], ref["centre"], ref["scale"], strict=True)]
    total = F.lit(0.0)
    for i, a in enumerate(z):
        for j, b in enumerate(z):
            total = total + a * b * float(ref["inverse"][i, j])
    return total


def in_range(ref: dict):
    out = F.lit(True)
    for c, lo, hi in zip(ref["cols"], ref["low"], ref["high"], strict=True):
        out = out & F.col(c).between(lo, hi)
    return out
