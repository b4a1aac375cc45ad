"""Calibrated filling, composites and codes on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import filling

COLS = "g string, y double, x double, lon double, lat double"


def test_calibration_against_least_squares(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(60, 3))
    y = 3 + 2 * p[:, 0] - p[:, 1] + 0.5 * p[:, 2] + rng.normal(scale=0.05, size=60)
    rows = [("a", None if k >= 50 else float(y[k]), *map(float, p[k])) for k in range(60)]
    rows += [("a", None, 900.0, 0.0, 0.0), ("a", None, None, 0.0, 0.0), ("a", float("nan"), -9999.0, 0.0, 0.0)]
    out, audit = filling.calibrated_fill(spark.createDataFrame(rows, COLS), "y", "x", ("lon", "lat"), ["g"])
    a = np.column_stack([np.ones(50), p[:50]])
    b = np.linalg.lstsq(a, y[:50], rcond=None)[0]
    got = {r.x: r for r in out.collect()}
    for k in range(50, 60):
        want = np.clip(b @ [1, *p[k]], y[:50].min(), y[:50].max())
        assert got[p[k, 0]].filled == pytest.approx(want) and got[p[k, 0]].method == "calibrated"
    assert got[900.0].filled == pytest.approx(y[:50].max())
    assert got[None].filled is None and got[None].method is None and got[-9999.0].filled is None
    r = audit.first()
    assert (r.n_pairs, r.n_missing, r.n_candidates, r.n_filled, r.method) == (50, 13, 11, 11, "calibrated")
    assert r.r2 == pytest.approx(1 - ((y[:50] - a @ b) ** 2).sum() / ((y[:50] - y[:50].mean()) ** 2).sum())


def test_direct_where_no_calibration_is_possible(spark):
    few = [("few", float(k), float(k), float(k % 3), float(k % 5)) for k in range(20)] + [("few", None, 7.5, 0.0, 0.0)]
    same = [("flat", float(k), float(k), 1.0, 1.0) for k in range(40)] + [("flat", None, 7.5, 1.0, 1.0)]
    none = [(None, float(k), float(k), float(k % 3), float(k % 5)) for k in range(3)]
    out, audit = filling.calibrated_fill(spark.createDataFrame(few + same + none, COLS), "y", "x", ("lon", "lat"), ["g"])
    assert out.count() == 65 and {(r.g, r.filled) for r in out.filter("method = 'direct'").collect()} == {("few", 7.5), ("flat", 7.5)}
    assert {r.g: r.method for r in audit.collect()} == {"few": "direct, too few pairs", "flat": "direct, low R2", None: "none needed"}
    empty, _ = filling.calibrated_fill(spark.createDataFrame([], COLS), "y", "x", ("lon", "lat"))
    assert empty.count() == 0


def test_composite_takes_one_whole_observation(spark):
    rows = [(1, 1, 0.1, 5.0, None), (1, 2, 0.5, 6.0, 1.0), (1, 3, 0.9, 7.0, 2.0), (1, 4, None, 8.0, 3.0), (2, 5, 0.2, 1.0, 1.0), (2, 6, 0.4, 2.0, 2.0), (3, 7, None, 1.0, 1.0)]
    o = spark.createDataFrame(rows, "cell int, k int, ix double, a double, b double")
    mid = {r.cell: r for r in filling.composite(o, ["cell"], "ix", 0.5, ["a", "b"], ["k"]).collect()}
    assert (mid[1].a, mid[1].b, mid[1].a_median) == (6.0, 1.0, 6.5)
    assert (mid[2].a, mid[2].target) == (1.0, pytest.approx(0.3))
    assert mid[3].a is None and mid[3].target is None and mid[3].a_median == 1.0
    low = {r.cell: r for r in filling.composite(o, ["cell"], "ix", 0.0, ["a", "b"], ["k"]).collect()}
    assert (low[1].a, low[1].b) == (5.0, None)


def test_codes(spark):
    f = spark.createDataFrame([(1, 2, "I", "North"), (2, None, "I", "North"), (3, None, "X", "South"), (4, None, None, "East")], "id int, code int, roman string, label string")
    roman = spark.createDataFrame([("I", 1), ("II", 2), ("I", 1)], "alias string, code int")
    names = spark.createDataFrame([("South", 3), (None, 9)], "alias string, code int")
    r = filling.resolve_codes(f, "code", {"roman": roman, "label": names})
    assert {x.id: (x.resolved, x.source) for x in r.collect()} == {1: (2, "code"), 2: (1, "roman"), 3: (3, "label"), 4: (None, None)}
    assert {x.fault: x.n for x in filling.code_faults(r, "label").collect()} == {"no code": 1, "code of two names": 0, "name of two codes": 1}
    with pytest.raises(ValueError):
        filling.resolve_codes(f, "code", {"roman": roman.union(spark.createDataFrame([("I", 4)], "alias string, code int"))})
    assert filling.resolve_codes(f.filter(F.lit(False)), "code", {"label": names}).count() == 0
