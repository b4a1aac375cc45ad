"""Block partitions, intervals and contrasts against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import partitions
from veldt.queries.partitions import SCENARIOS, TERMS, contrasts


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(r, c) for r in range(17) for c in range(11)], "row long, col long")


def shape(spark, rows=17, cols=11):
    return spark.createDataFrame([(rows, cols)], "rows long, cols long")


def blocks(df):
    out = {}
    for x in df.collect():
        out.setdefault((x.r0, x.r1, x.c0, x.c1), set()).add((x.row, x.col))
    return out


def test_every_block_holds_what_its_bounds_say(spark, cells):
    for mode, off in (("balanced", (0, 0)), ("partial", (3, 2)), ("drop", (3, 2)), ("partial", (8, 6))):
        found = blocks(partitions.assign(cells, shape(spark), (5, 4), off, mode))
        for (r0, r1, c0, c1), held in found.items():
            assert held == {(r, c) for r in range(r0, r1) for c in range(c0, c1)}
            if mode == "drop":
                assert (r1 - r0, c1 - c0) == (5, 4)
        if mode != "drop":
            assert sum(map(len, found.values())) == 17 * 11
    sizes = {r1 - r0 for r0, r1, _, _ in blocks(partitions.assign(cells, shape(spark), (5, 4)))}
    assert sizes == {5, 6}
    assert len(blocks(partitions.assign(cells, shape(spark), (50, 40)))) == 1
    assert partitions.assign(cells, shape(spark), (50, 40), mode="drop").count() == 0
    assert partitions.assign(cells.limit(0), shape(spark), (5, 4)).count() == 0


def test_refusals(spark, cells):
    for args in (((5, 4), (1, 0), "balanced"), ((0, 4), (0, 0), "drop"), ((5, 4), (0, 0), "other")):
        with pytest.raises(ValueError):
            partitions.assign(cells, shape(spark), *args)


def test_interval_is_turned_about_the_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(f"b{k}", 20, float(s), float(s * s / 20 + 30), 60.0, float(3 * s * s / 20 + x), float(6 * s)) for k, (s, x) in enumerate(zip(rng.normal(40, 3, 12), rng.normal(20, 4, 12), strict=True))]
    sums = spark.createDataFrame(rows, "block string, n long, sx double, sxx double, pairs double, xx double, xs double")
    whole = spark.createDataFrame([(300, 0.25)], "n long, i double")
    a = partitions.moran_interval(sums, whole, 60, 1).withColumn("why", partitions.reasons("drop")).first()
    assert a.n_blocks == 12 and a.n_finite == 60 and a.coverage == pytest.approx(0.8)
    assert a.basic_low + a.percentile_high == pytest.approx(2 * a.i) and a.basic_high + a.percentile_low == pytest.approx(2 * a.i)
    assert a.basic_low < a.i < a.basic_high and a.difference == pytest.approx(a.part - a.i)
    assert a.why.split(",")[:2] == ["fewer_than_20_blocks", "coverage_below_95pct"]
    # without pairs no replicate is finite: no bounds
    none = partitions.moran_interval(sums.withColumn("pairs", F.lit(0.0)), whole, 60, 1).first()
    assert none.n_finite == 0 and none.basic_low is None and none.percentile_high is None


def test_all_contrasts(spark):
    assert len({c for _, c, _, _ in TERMS}) == 22
    r2 = {s: 0.1 * k * k for k, s in enumerate(SCENARIOS)}
    got = {x.contrast: x.v for x in contrasts(spark.createDataFrame(list(r2.items()), "scenario string, r2 double"), []).collect()}
    assert len(got) == 22
    assert got["R_Env_from_Integrated"] == pytest.approx(r2["S4_Integrated"] - r2["S3_RS_Full"])
    assert got["S_Prod_Temp_given_Het"] == pytest.approx((r2["S2c_Het_Temp"] - r2["S1b_Het"]) - (r2["S3_RS_Full"] - r2["S2a_Prod_Het"]))
    # a contrast without one of its scenarios is not there
    less = spark.createDataFrame([x for x in r2.items() if x[0] != "S0_Env"], "scenario string, r2 double")
    assert contrasts(less, []).count() == 20
