"""Grids of several bands against plain loops and known figures."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import raster


def made(spark, rows, schema="row long, col long, a double, b double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(3)
    return [(r, c, float(rng.integers(0, 9)), float(rng.integers(1, 9))) for r in range(9) for c in range(8) if (r * 8 + c) % 7]


def test_equal_geometries_only_mask(spark):
    g = raster.Geometry(0, 0, 2, 2)
    t = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, None), (1, 1, float("nan")), (2, 2, 5.0)], "row long, col long, v double")
    s = made(spark, [(0, 0, 1.0, 2.0), (0, 1, 3.0, 4.0)])
    rows = lambda df: {(r.row, r.col): r.a for r in df.collect()}
    assert rows(raster.align(s, g, t, g, ["a", "b"])) == {(0, 0): 1.0, (2, 2): None}
    assert rows(raster.align(s, g, t, g, ["a"], zero_is_missing=False)) == {(0, 0): 1.0, (0, 1): 3.0, (2, 2): None}


def test_bilinear_keeps_planes_and_spreads_over_the_valid(spark):
    frm, to = raster.Geometry(0, 0, 4, 4), raster.Geometry(5, -5, 3, 3)
    x = lambda c: (c + 0.5) * 4
    plane = made(spark, [(r, c, 2 * x(c) - x(r), None if (r, c) == (2, 2) else 7.0) for r in range(8) for c in range(8)])
    t = spark.createDataFrame([(r, c, 1.0) for r in range(5) for c in range(5)], "row long, col long, v double")
    got = raster.align(plane, frm, t, to, ["a", "b"]).collect()
    assert len(got) == 25
    for r in got:
        assert r.a == pytest.approx(2 * (5 + (r.col + 0.5) * 3) - (5 + (r.row + 0.5) * 3)) and r.b == pytest.approx(7.0)
    assert raster.align(plane.limit(0), frm, t, to, ["a"]).filter("a is not null").count() == 0
    with pytest.raises(ValueError):
        raster.align(plane, frm, t, to, ["a"], method="cubic")


def test_edges_belong_to_the_cell_after_them(spark):
    p = spark.createDataFrame([(0.0, 0.0), (4.0, -4.0), (3.9, -3.9), (-0.1, 0.0), (None, 1.0), (0.0, 0.0)], "x double, y double")
    g = made(spark, [(0, 0, 1.0, 1.0), (1, 1, 2.0, 2.0)])
    got = sorted(((r.x, r.y, r.a) for r in raster.at_points(p, g, raster.Geometry(0, 0, 4, 4), ["a"]).collect()), key=str)
    assert got == sorted([(0.0, 0.0, 1.0), (0.0, 0.0, 1.0), (4.0, -4.0, 2.0), (3.9, -3.9, 1.0), (-0.1, 0.0, None), (None, 1.0, None)], key=str)


def test_the_whole_ellipsoid(spark):
    bands = spark.range(-90, 90).select(raster.ellipsoid_area(F.col("id").cast("double"), F.col("id") + 1.0, F.lit(360.0)).alias("a"))
    assert bands.agg(F.sum("a")).first()[0] == pytest.approx(510065621.724, abs=0.01)


def test_morphology_against_loops(spark, scene):
    at = {(r, c): np.array([a, b]) for r, c, a, b in scene}
    got = {(r.row, r.col): r for r in raster.spectral_morphology(made(spark, scene), ["a", "b"]).collect()}
    assert set(got) == set(at)
    for (r, c), x in got.items():
        near = [((dr, dc), at[r + dr, c + dc]) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (r + dr, c + dc) in at]
        m = np.mean([s for _, s in near], axis=0)
        cos = lambda s: round(float(s @ m / math.sqrt((s @ s) * (m @ m))) if s.any() and m.any() else 0.0, 9)  # noqa: B023, E731
        far, close = min(near, key=lambda e: (cos(e[1]), e[0]))[1], min(near, key=lambda e: (-cos(e[1]), e[0]))[1]
        assert (x.a_dilation, x.b_dilation, x.a_erosion, x.b_erosion) == (*far, *close)
        assert x.a_gradient == far[0] - close[0]


def test_spread_against_loops(spark, scene):
    at = {(r, c): (a, b) for r, c, a, b in scene}
    got = {(r.row, r.col): r for r in raster.spectral_spread(made(spark, [*scene, (20, 20, None, 1.0)]), ["a", "b"], 2).collect()}
    assert set(got) == set(at)
    for (r, c), x in got.items():
        w = np.array([v for (i, j), v in at.items() if abs(i - r) <= 2 and abs(j - c) <= 2])
        assert x.sg == pytest.approx(math.sqrt(w.var(axis=0).mean())) and x.sd == pytest.approx(math.sqrt((np.ptp(w, axis=0) ** 2).mean()))


def test_texture_of_plain_and_striped_squares(spark):
    flat = raster.texture(spark.createDataFrame([(r, c, 4) for r in range(5) for c in range(5)], "row long, col long, v long"), 1)
    for r in flat.collect():
        assert (r.contrast, r.asm, r.entropy, r.variance, r.correlation) == (0, 1, 0, 0, None)
    # stripes by column: neighbours in a column are alike, all others differ by two
    s = raster.texture(spark.createDataFrame([(r, c, 2 * (c % 2)) for r in range(9) for c in range(9)], "row long, col long, v long"), 1)
    mid = s.filter("row = 4 and col = 4").first()
    assert mid.contrast == pytest.approx(3.0) and mid.dissimilarity == pytest.approx(1.5)
    assert mid.correlation == pytest.approx((-1 - 1 - 1 + 1) / 4)
    assert raster.texture(spark.createDataFrame([], "row long, col long, v long")).count() == 0


def test_geometries(spark):
    cols = "crs string, rows int, cols int, left double, top double, width double, height double"
    like = spark.createDataFrame([("A", 3, 4, 0.0, 10.0, 2.0, 2.0)], cols)
    g = spark.createDataFrame([("A", 3, 4, 0.0, 10.0 + 1e-12, 2.0, 2.0), (None, 3, 4, 0.0, 10.0, 2.0, 2.0), ("A", 4, 4, 1.0, 10.0, 2.5, 2.0)], cols)
    assert [r.faults for r in raster.geometry_faults(g, like).collect()] == ["", "system", "shape,size,place"]
