"""Isotonic maps, keyed AR(1) series and bias correction."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import calibration


def pooled(y):
    """Adjacent violators pooled, one after the other."""
    runs = []
    for v in y:
        runs.append([v, 1])
        while len(runs) > 1 and runs[-2][0] >= runs[-1][0]:
            (b, n), (a, m) = runs.pop(), runs.pop()
            runs.append([(a * m + b * n) / (m + n), m + n])
    return [v for v, n in runs for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_isotonic(spark, seed):
    r = random.Random(seed)
    y = [r.choice((i / 5, r.random() * 4, 1.0)) for i in range(17)]
    got = calibration.isotonic(spark.createDataFrame([(float(i), v) for i, v in enumerate(y)], "x double, y double"), "x", "y").orderBy("x").collect()
    assert [g.iso for g in got] == pytest.approx(pooled(y))


def test_series(spark):
    draws = spark.range(1, 1500).select(F.col("id").alias("draw"), F.explode(F.array(F.lit(0.0), F.lit(0.6), F.lit(-0.5))).alias("rho"))
    s = calibration.ar1_series(draws, 2001, 2020, "t").cache()
    wide = s.groupBy("rho", "draw").pivot("t").agg(F.first("v")).toPandas()
    for rho in (0.0, 0.6, -0.5):
        v = wide[wide.rho == rho].drop(columns=["rho", "draw"]).to_numpy()
        assert v.shape == (1499, 20) and abs(v.mean()) < 0.05 and abs(v.std() - 1) < 0.03
        assert abs(np.mean(v[:, 1:] * v[:, :-1]) - rho) < 0.03
    again = calibration.ar1_series(draws.repartition(13), 2001, 2020, "t")
    assert again.agg(F.sum(F.xxhash64("rho", "draw", "t", "v").cast("decimal(38,0)"))).first() == s.agg(F.sum(F.xxhash64("rho", "draw", "t", "v").cast("decimal(38,0)"))).first()


def test_residual_rho(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(5, 12)).cumsum(1)
    rows = [(i, t, float(x)) for i, row in enumerate(v) for t, x in enumerate(row)] + [(9, t, 2.0) for t in range(12)]
    got = {x.cell: x.rho for x in calibration.lag1_of_residuals(spark.createDataFrame(rows, "cell int, t int, v double"), ["cell"]).collect()}
    t = np.arange(12)
    for i, row in enumerate(v):
        e = row - np.polyval(np.polyfit(t, row, 1), t)
        assert got[i] == pytest.approx((e[1:] * e[:-1]).sum() / np.sqrt((e[1:] ** 2).sum() * (e[:-1] ** 2).sum()))
    assert got[9] is None


def test_correction(spark):
    """Plateaus count once, ends are flat and clipped, and known series come back near their rho."""
    table = spark.createDataFrame([(-0.9, -0.6), (-0.3, -0.2), (0.3, -0.2), (0.99, 0.5)], "true_rho double, iso double")
    raw = spark.createDataFrame([(-1.0,), (-0.6,), (-0.4,), (-0.2,), (0.15,), (0.5,), (2.0,), (None,)], "rho double")
    got = {x.rho: x.corrected for x in calibration.correct_rho(raw, table, 0.95).collect()}
    assert [got[k] for k in (-1.0, -0.6, -0.4, -0.2, 0.15, 0.5, 2.0)] == pytest.approx([-0.9, -0.9, -0.45, 0.0, 0.495, 0.95, 0.95])
    mapping = calibration.bias_map(spark, [-0.6, -0.3, 0.0, 0.3, 0.6], 150, 1, 20)
    known = calibration.ar1_series(spark.range(1000, 1300).select(F.col("id").alias("draw"), F.lit(0.4).alias("rho")), 1, 20, "other").drop("rho")
    est = calibration.lag1_of_residuals(known, ["draw"]).agg(F.median("rho").alias("rho"))
    x = calibration.correct_rho(est, mapping).first()
    assert x.rho < 0.3 and abs(x.corrected - 0.4) < 0.12
