"""Profiles, sensitivities, hold-outs, ranks, the gate and acceptance on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import sensitivity

CODES = {"H+": 1, "L0": 2}


def test_profile_of_a_known_response(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(7)], "id long, x double")
    f = sensitivity.over_grid(rows.withColumn("age", F.lit(0.0)), "age", [1, 10]).withColumn("p", F.col("x") * F.col("age")).withColumn("none", F.lit(None).cast("double"))
    got = {r.age: r for r in sensitivity.profile(f, "age", ["p", "none"]).collect()}
    assert set(got) == {1.0, 10.0}
    v = np.arange(7) * 10.0
    r = got[10.0]
    assert (r.n, r.mean, r.median, r.least, r.greatest) == (7, v.mean(), np.median(v), 0, 60)
    assert r.q05 == pytest.approx(np.quantile(v, 0.05)) and r.q95 == pytest.approx(np.quantile(v, 0.95))
    assert sensitivity.profile(f.limit(0), "age", ["p"]).count() == 0


def test_against_reference(spark):
    f = spark.createDataFrame([(1, 80, 5.0), (1, 100, 4.0), (2, 80, 1.0), (2, 100, 1e-9), (3, 80, 7.0), (4, 80, None), (4, 100, 2.0)], "id long, age int, p double")
    got = {r.id: (r.p_change, r.p_percent) for r in sensitivity.against_reference(f, ["id"], "age", 100, ["p"]).collect()}
    assert got[1] == (1.0, 25.0) and got[2] == (pytest.approx(1.0), None) and got[3] == (None, None) and got[4] == (None, None)


def test_hold_outs_clamp_to_what_was_learned(spark):
    rows = spark.createDataFrame([(float(k % 60), float(k)) for k in range(240)] + [(None, 0.0)], "age double, y double")
    found = sensitivity.limits(rows, "age", [50.0, 59.0, 5.0])
    seen = {r.threshold: (r.n_held, r.n_train, r.train_max, r.status) for r in found.collect()}
    assert seen == {50.0: (40, 200, 49.0, "ok"), 59.0: (4, 236, 58.0, "too few"), 5.0: (220, 20, 4.0, "too few")}
    train, test = sensitivity.held_out(rows, "age", found)
    assert train.count() == 200 and test.count() == 80
    assert [r.age for r in test.filter("mode = 'clamped'").select("age").distinct().collect()] == [49.0]
    assert test.filter("mode = 'uncapped'").agg(F.max("age")).first()[0] == 59.0


def test_coverage_and_verdict(spark):
    rng = np.random.default_rng(2)
    y, q = rng.normal(size=50), rng.normal(size=50)
    q[:5] = y[:5]
    f = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, q, strict=True)] + [(None, 1.0), (1.0, None)], "y double, q90 double")
    r = sensitivity.coverage(f, [], "y", {"q90": 0.9}).first()
    e = y - q
    assert r.n == 50 and r.coverage == pytest.approx((e <= 0).mean()) and r.gap == pytest.approx((e <= 0).mean() - 0.9)
    assert r.pinball == pytest.approx(np.where(e >= 0, 0.9 * e, -0.1 * e).mean()) and r.bias == pytest.approx(-e.mean())
    v = spark.createDataFrame([(100.0, 0.99, 0.0), (150.0, 0.8, 20.0), (150.0, 0.88, 12.0), (150.0, 0.95, 5.0)], "a double, c double, o double")
    said = [x.v for x in v.select(sensitivity.verdict(F.col("a"), F.col("c"), F.col("o")).alias("v")).collect()]
    assert said == ["not reached", "unreliable, a lower bound", "within the area of applicability only", "credible"]


def test_fair_ranking(spark):
    rows = [("a", 1, 3.0), ("b", 1, 3.0), ("a", 2, 1.0), ("b", 2, 2.0), ("a", 3, 0.1), ("b", 4, None), ("a", 4, 0.2)]
    r = spark.createDataFrame(rows, "response string, setting int, score double")
    got = {x.setting: (x.complete, x.place) for x in sensitivity.fair_ranking(r, "response", "setting", "score").collect()}
    assert got == {1: (True, 2), 2: (True, 1), 3: (False, None), 4: (False, None)}
    lone = r.filter("setting > 2 or (setting = 1 and response = 'b')")
    assert {x.setting: x.place for x in sensitivity.fair_ranking(lone, "response", "setting", "score").collect()} == {3: 1, 4: 2, 1: 3}


@pytest.fixture(scope="module")
def sides(spark):
    p = "response string, rho double, breaks long, modal_year int"
    s = p + ", least_p double, cutoff double"
    return lambda a, b: (spark.createDataFrame(a, p), spark.createDataFrame(b, s))


def gate(sides, a, b):
    return {r.response: r for r in sensitivity.rho_gate(*sides(a, b)).collect()}


def test_gate_classes(sides):
    g = gate(sides, [("x", 0.1, 10, 2008), ("y", 0.1, 0, 2010), ("z", 0.1, 100, 2010), ("w", 0.1, 100, 2010)], [("x", 0.3, 5, 2009, 0.001, 0.01), ("y", 0.3, 0, None, 0.001, None), ("z", 0.3, 49, 2012, 0.001, 0.009), ("w", 0.3, 9, 2010, 0.001, 0.02)])
    assert [g[k].retention_class for k in "xyzw"] == ["ROBUST", "PRIMARY_ZERO_RECOVERY", "SENSITIVE", "COLLAPSE"]
    assert [g[k].floor_class for k in "xyzw"] == ["CLEAR_OF_MC_FLOOR", "NO_FDR_CUTOFF", "NEAR_MC_FLOOR", "CLEAR_OF_MC_FLOOR"]
    assert [g[k].year_class for k in "xyzw"] == ["MODAL_YEAR_STABLE", "NOT_EVALUABLE", "MODAL_YEAR_SHIFT", "MODAL_YEAR_STABLE"]
    assert [g[k].row_gate for k in "xyzw"] == ["GO", "GO", "CONDITIONAL_GO", "CONDITIONAL_GO"]
    assert {(r.overall, r.severity) for r in g.values()} == {("CONDITIONAL_GO", "SEVERE_RHO_MODEL_SENSITIVITY")}


def test_gate_integrity(sides):
    g = gate(sides, [("x", None, 10, 2008), ("y", 0.1, 4, 2010)], [("x", 0.3, 5, 2009, 0.001, 0.01), ("y", 0.3, 4, 2010, 0.001, 0.01)])
    assert g["x"].row_gate == "NO_GO" and g["y"].row_gate == "GO" and g["y"].overall == "NO_GO" and g["y"].severity == "GATE_INTEGRITY_FAILURE"
    for a, b in (([("x", 0.1, 1, 1)], [("y", 0.1, 1, 1, 0.1, 0.1)]), ([("x", 0.1, 1, 1)] * 2, [("x", 0.1, 1, 1, 0.1, 0.1)])):
        with pytest.raises(ValueError):
            sensitivity.rho_gate(*sides(a, b))


def accepted(spark, raster, summary):
    cells = spark.createDataFrame([(1, "A", "H+", 2.0), (2, "A", "L0", 3.0), (3, "B", None, 1.0), (4, "B", "other", 1.0)], "cell long, zone string, class6 string, area double")
    r = spark.createDataFrame(raster, "cell long, code int")
    s = spark.createDataFrame(summary, "zone string, class6 string, n long, area double")
    return {x.fault: x.n for x in sensitivity.acceptance(cells, r, s, CODES, ["A", "B"]).collect() if x.status == "FAIL"}


def test_acceptance(spark):
    raster = [(1, 1), (2, 2), (3, None), (4, None), (9, 2)]
    summary = [("A", "H+", 1, 2.0), ("A", "L0", 1, 3.0), ("B", "H+", 0, 0.0), ("B", "L0", 0, 0.0), ("Overall", "H+", 1, 2.0), ("Overall", "L0", 1, 3.0)]
    assert accepted(spark, raster, summary) == {}
    assert accepted(spark, [(1, 2), (2, None), (3, 7)], [*summary[1:], summary[1]]) == {"unknown code": 1, "cell outside the raster": 1, "class and code differ": 3, "summary row missing or repeated": 2}
    assert accepted(spark, raster, [("A", "H+", 2, 2.0), ("A", "L0", 1, 3.1), *summary[2:]]) == {"summary and cells differ": 2}
