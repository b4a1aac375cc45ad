"""Fixed vectors and independent numpy versions of the kernels."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.functions.scalars import draw, harmonic, two_sided
from veldt.operators import blocks, breaks, fdr, spatial, trend
from veldt.operators.series import complete, pack
from veldt.sources.sinks import publish, scaled_int
from veldt.sources.tables import fingerprint, missing_years, yearly_files


def hinge_series(spark, f, cell=1):
    return spark.createDataFrame([(cell, y, float(f(y))) for y in range(2001, 2021)], "cell int, t int, v double")


def test_exact_hinge(spark):
    r = breaks.hinge_fits(hinge_series(spark, lambda y: -0.5 * y + 1.2 * max(0, y - 2010)), 2001, 2020).first()
    assert (r.tau, r.status, r.direction_ok) == (2010, "exact_hinge", True) and math.isinf(r.supf)
    assert r.slope_before == pytest.approx(-0.5) and r.slope_after == pytest.approx(0.7)


def test_linear_and_constant(spark):
    assert breaks.hinge_fits(hinge_series(spark, lambda y: 2 + 0.3 * (y - 2010.5)), 2001, 2020).first().status == "perfect_linear"
    r = breaks.hinge_fits(hinge_series(spark, lambda y: 4.0), 2001, 2020).first()
    assert r.supf == 0 and r.tau == 2005 and r.tie_count > 1


def test_scale_invariance_and_gaps(spark):
    r = random.Random(1)
    v = {y: r.gauss(0, 1) for y in range(2001, 2021)}
    a = breaks.hinge_fits(hinge_series(spark, v.get), 2001, 2020).first()
    b = breaks.hinge_fits(hinge_series(spark, lambda y: v[y] * 1e-6), 2001, 2020).first()
    assert a.tau == b.tau and a.supf == pytest.approx(b.supf, rel=1e-6)
    assert breaks.hinge_fits(hinge_series(spark, v.get).filter("t <> 2010"), 2001, 2020).count() == 0
    best = min(((np.linalg.lstsq(np.stack([np.ones(20), np.arange(2001, 2021), np.maximum(0, np.arange(2001, 2021) - t)], 1).astype(float), np.array(list(v.values())), rcond=None)[1][0]), t) for t in range(2005, 2016))
    assert (a.tau, a.sse1) == (best[1], pytest.approx(best[0], rel=1e-6))


@pytest.mark.parametrize("margin, first, last", [(5, 2005, 2015), (4, 2004, 2016), (3, 2003, 2017), (2, 2002, 2018)])
def test_candidates(spark, margin, first, last):
    r = breaks.hinges(spark, 2001, 2020, margin).agg(F.min("tau").alias("a"), F.max("tau").alias("b")).first()
    assert (r.a, r.b) == (first, last)


def test_exceedance_counts_ties(spark):
    null = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "stat double")
    got = {r.cell: (r.k, r.p) for r in breaks.exceedance(spark.createDataFrame([(1, 2.0), (2, math.inf)], "cell int, stat double"), null, 4).collect()}
    assert got == {1: (3, 0.8), 2: (0, 0.2)}


def test_trend_against_numpy(spark):
    r = random.Random(2)
    rows = [(c, t, float(r.choice((r.randint(0, 4), r.gauss(0, 2))))) for c in range(6) for t in range(14) if r.random() < 0.9]
    got = {x.cell: x for x in trend.with_trend(pack(spark.createDataFrame(rows, "cell int, t int, v double"))).collect()}
    for c in range(6):
        pts = [(t, v) for k, t, v in rows if k == c]
        pairs = [(b[0] - a[0], b[1] - a[1]) for i, a in enumerate(pts) for b in pts[i + 1 :]]
        n, counts = len(pts), [[v for _, v in pts].count(u) for u in {v for _, v in pts}]
        assert got[c].sen_slope == pytest.approx(float(np.median([y / x for x, y in pairs])))
        assert got[c].s_stat == sum((y > 0) - (y < 0) for _, y in pairs)
        assert got[c].var_s == pytest.approx((n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in counts)) / 18)
        z = (got[c].s_stat - np.sign(got[c].s_stat)) / math.sqrt(got[c].var_s)
        assert got[c].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


def test_short_and_missing_series(spark):
    rows = [(1, 1, 1.0), (1, 2, None), (2, 1, 5.0), (2, 2, 6.0), (2, 3, 7.0)]
    s = spark.createDataFrame(rows, "cell int, t int, v double")
    assert [r.cell for r in complete(s).select("cell").distinct().collect()] == [2]
    got = {r.cell: r for r in trend.with_hamed_rao(trend.with_trend(pack(s))).collect()}
    assert got[1].s_stat is None and got[1].p is None and got[2].sen_slope == 1


def test_adjust_against_sorting(spark):
    r = random.Random(3)
    p = [r.choice((0.01, 0.02, 0.2, 0.5, r.random())) for _ in range(60)] + [None]
    got = fdr.adjust(spark.createDataFrame([(i, "f", x) for i, x in enumerate(p)], "i int, family string, p double"), ["family"]).collect()
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    m, low, want = len(known), 1.0, {}
    for k in range(m, 0, -1):
        low = min(low, known[k - 1][0] * m / k)
        want[known[k - 1][1]] = low
    h = sum(1 / i for i in range(1, m + 1))
    for x in got:
        if x.p is None:
            assert x.q_bh is None
        else:
            assert x.q_bh == pytest.approx(want[x.i]) and x.q_by == pytest.approx(min(1, want[x.i] * h)) and x.q_bky <= x.q_bh + 1e-12


def test_normal_tail_and_harmonic(spark):
    z = [0.0, 0.5, -1.96, 3.0, 4.5, 6.1, 9.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(two_sided(F.col("z")).alias("p")).collect()
    for x, r in zip(z, got, strict=True):
        assert r.p == pytest.approx(math.erfc(abs(x) / math.sqrt(2)), abs=2e-15)
    assert spark.range(1).select(harmonic(F.lit(4)).alias("h")).first().h == pytest.approx(25 / 12)


def test_weights_do_not_depend_on_partitions(spark):
    b = spark.createDataFrame([("z", i) for i in range(9)], "zone string, block int")
    one = sorted(blocks.weights(b.repartition(1), ["zone"], 20, 5).collect())
    many = sorted(blocks.weights(b.repartition(7, "block"), ["zone"], 20, 5).collect())
    assert one == many and all(sum(r.w for r in one if r.rep == k) == 9 for k in range(1, 21))


def test_moran_hot_block(spark):
    r = random.Random(4)
    g = {(i, j): None if i == 0 else r.gauss(0, 1) + 5 * (20 <= i <= 29 and 20 <= j <= 29) for i in range(50) for j in range(50)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in g.items()], "row int, col int, v double")
    s = spatial.moran_sums(df).withColumn("i", spatial.moran_from(*[F.col(c) for c in ("n", "sx", "sxx", "w", "xx", "xs")])).first()
    ok = {k: v for k, v in g.items() if v is not None}
    mean = sum(ok.values()) / len(ok)
    near = [(k, (k[0] + a, k[1] + b)) for k in ok for a, b in spatial.QUEEN if (k[0] + a, k[1] + b) in ok]
    want = len(ok) / len(near) * sum((ok[a] - mean) * (ok[b] - mean) for a, b in near) / sum((v - mean) ** 2 for v in ok.values())
    assert s.i == pytest.approx(want) and s.i > 0.2 and s.w == len(near)
    z = {(x.row, x.col): x.z for x in spatial.gi_star(df).collect()}
    centre = [z[i, j] for i in range(22, 28) for j in range(22, 28)]
    assert sum(centre) / len(centre) > 2 and (0, 5) not in z


def test_focal_window(spark):
    df = spark.createDataFrame([(i, j, None if (i + j) % 7 == 0 else float(i * j)) for i in range(8) for j in range(8)], "row int, col int, v double")
    for x in spatial.focal_square(df, 2).collect():
        v = [i * j for i in range(8) for j in range(8) if (i + j) % 7 and abs(i - x.row) <= 2 and abs(j - x.col) <= 2]
        assert x.n == len(v) and x.mean == pytest.approx(np.mean(v)) and x.sd == pytest.approx(np.std(v), abs=1e-9)


def test_sources_and_sinks(spark, tmp_path):
    for y in (2001, 2003):
        (tmp_path / f"sr_{y}.bin").write_bytes(str(y).encode())
    files = yearly_files(spark, str(tmp_path))
    assert sorted(r.year for r in files.collect()) == [2001, 2003]
    assert [r.year for r in missing_years(files, 2001, 2003).collect()] == [2002]
    mark = fingerprint(spark, str(tmp_path))
    (tmp_path / "sr_2003.bin").write_bytes(b"new")
    assert len(mark) == 12 and fingerprint(spark, str(tmp_path)) != mark
    v = spark.createDataFrame([(0.5,), (-99.99,), (9e9,), (None,)], "v double").select(scaled_int(F.col("v"), 100).alias("n"))
    assert [r.n for r in v.collect()] == [50, -9998, 32767, -9999]
    for k in (3, 5):
        publish(spark.range(k), f"{tmp_path}/out")
        assert spark.read.parquet(f"{tmp_path}/out").count() == k


def test_draw_is_stable(spark):
    import hashlib

    assert spark.range(1).select(draw("s", F.lit(5)).alias("x")).first().x == int(hashlib.md5(b"s|5").hexdigest()[:8], 16)


def test_observation_bootstrap(spark):
    import numpy as np

    from veldt.operators.simulate import observation_bootstrap, poisson
    from veldt.queries.blocks import summarised

    w = np.stack([poisson(np.arange(5000), r, 1) for r in range(1, 41)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    rng = np.random.default_rng(5)
    y = rng.normal(1000, 10, 400)
    p1, p2, p3 = y + rng.normal(0, 8, 400), y + rng.normal(0, 3, 400), y + rng.normal(0, 3, 400)
    rows = [(i, *map(float, v)) for i, v in enumerate(zip(y, p1, p2, p3))] + [(900, None, 1.0, 1.0, 1.0), (901, 1.0, float("nan"), 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "plot long, y double, p1 double, p2 double, p3 double")
    got = {x.name: x for x in summarised(observation_bootstrap(frame, "plot", "y", ["p1", "p2", "p3"])).collect()}
    again = {x.name: x for x in summarised(observation_bootstrap(frame.repartition(3), "plot", "y", ["p1", "p2", "p3"])).collect()}
    want = 1 - ((y - p1) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(got["p1"].estimate - want) < 1e-9 and got["p1"].n_obs == 400 and got["p1"].n_boot == 2000 and got["p1"].p is None
    draws = [1 - ((y[k] - p1[k]) ** 2).sum() / ((y[k] - y[k].mean()) ** 2).sum() for k in rng.integers(0, 400, (2000, 400))]
    assert np.allclose([got["p1"].low, got["p1"].high], np.quantile(draws, [0.025, 0.975]), atol=0.02)
    assert got["p2-p1"].low > 0 and abs(got["p2-p1"].p - 2 / 2001) < 1e-12 and got["p3-p2"].p > 0.01
    assert all(abs(got[k].low - again[k].low) < 1e-9 for k in got)
    few = summarised(observation_bootstrap(frame, "plot", "y", ["p1", "p2", "p3"], reps=99)).filter("name = 'p1'").first()
    assert few.low is None and few.estimate is not None


def test_patches_of_many_rounds_keep_a_small_plan(spark):
    """Each round starts from files: what Spark takes the labels' size to be stays near their size, however many rounds there were."""
    rows = range(9)
    path = [(r, c) for r in rows for c in (rows if r % 2 == 0 else [8 if r % 4 == 1 else 0])] + [(20, 20), (21, 21)]
    got = spatial.patches(spark.createDataFrame(path, "row int, col int"))
    assert {(x.row, x.col): x.patch for x in got.collect()} == {(r, c): "20_20" if r > 9 else "0_0" for r, c in path}
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20
