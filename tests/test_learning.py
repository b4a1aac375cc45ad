"""Screening, allocation, keyed choice, nested validation and its contract against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import screening, validation


def ranks(v):
    v = np.array(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_family_names():
    assert [screening.family(n) for n in ("ndvi_w3_mean", "ndvi_300m", "ndvi_1km_sd", "w3", "a_w3b", "b_12km_w5")] == ["ndvi_mean", "ndvi", "ndvi_sd", "w3", "a_w3b", "b"]


def test_average_ranks(spark):
    r = random.Random(1)
    rows = [(i, r.choice((1.0, 2.0, r.random())), float(r.randrange(5)), None if i % 9 == 0 else r.random()) for i in range(120)]
    got = {x.id: x for x in screening.average_ranks(spark.createDataFrame(rows, "id int, a double, b double, c double"), "id", ["a", "b", "c"]).collect()}
    for j, c in enumerate("abc", 1):
        there = [x for x in rows if x[j] is not None]
        assert [got[x[0]][c] for x in there] == list(ranks([x[j] for x in there]))
    assert got[0].c is None and len(got) == 120


def test_spearman_needs_no_row(spark):
    """From counts alone, over rows that repeat and lack values, as the correlation of average ranks."""
    r = random.Random(4)
    rows = [(i, float(r.randrange(6)), None if i % 7 == 0 else r.random(), 2.0, None if i % 5 == 0 else float(r.randrange(4))) for i in range(150)] * 2
    df = spark.createDataFrame([(i, *x[1:]) for i, x in enumerate(rows)], "id int, a double, b double, c double, y double")
    got = screening.spearman(df, ["a", "b", "c"], "y")
    for j, c in enumerate("abc", 1):
        mine, theirs = ({i: v for i, v in zip([i for i, x in enumerate(rows) if x[k] is not None], ranks([x[k] for x in rows if x[k] is not None]), strict=True)} for k in (j, 4))
        both = [i for i in mine if i in theirs]
        assert got[c] == (0 if c == "c" else pytest.approx(abs(np.corrcoef([mine[i] for i in both], [theirs[i] for i in both])[0, 1])))
    assert screening.spearman(df, [], "y") == {}


def test_screen(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        a, b, y = r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)
        rows.append((i, a, a + r.gauss(0, 2), b, a + b + 1e-3 * r.gauss(0, 1), 5.0, y + a + b / 2))
    names = ["a_w3", "a_w9", "b", "sum_100m", "flat"]
    df = spark.createDataFrame(rows, ["id", *names, "y"])
    got = {x.feature: x for x in screening.screen(df, "id", names, "y").collect()}
    assert "flat" not in got and got["a_w3"].scale_kept and not got["a_w9"].scale_kept and got["a_w9"].vif is None
    cols = {n: np.array([x[k + 1] for x in rows]) for k, n in enumerate([*names, "y"])}
    for n in names[:-1]:
        assert got[n].rho == pytest.approx(abs(np.corrcoef(ranks(cols[n]), ranks(cols["y"]))[0, 1]))
    assert sum(x.kept for x in got.values()) == 2 and max(x.vif for x in got.values() if x.kept) <= 10
    x = np.stack([cols["a_w3"], cols["b"], cols["a_w9"]])
    want = []
    for j in range(3):
        rest = np.stack([np.ones(400), *[x[i] for i in range(3) if i != j]], 1)
        e = x[j] - rest @ np.linalg.lstsq(rest, x[j], rcond=None)[0]
        want.append(((x[j] - x[j].mean()) ** 2).sum() / (e @ e))
    assert screening.inflation(np.corrcoef(x)) == pytest.approx(want)
    assert list(screening.inflation(np.ones((1, 1)))) == [1.0] and np.isinf(screening.inflation(np.ones((2, 2)))).all()


@pytest.mark.parametrize("total, least", [(0, 5), (3, 5), (40, 8), (120, 10), (500, 10), (10_000, 3)])
def test_allocate(total, least):
    counts = {0: 400, 1: 3, 2: 0, 3: 77, 4: 20, 5: 1}
    give = screening.allocate(counts, total, least)
    assert give.keys() == counts.keys() and all(0 <= give[k] <= counts[k] for k in counts)
    assert sum(give.values()) == min(total, 501)
    if total >= 40:
        assert all(give[k] >= 1 for k, n in counts.items() if n) and give[0] >= give[3] >= give[4]
    if total >= 120:
        assert all(give[k] >= min(least, n) for k, n in counts.items())


def test_draw_strata(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 7 > 4).cast("string")).alias("s"))
    give = spark.createDataFrame([("true", 12), (None, 4), ("gone", 3)], "s string, take long")
    got = screening.draw_strata(df, "s", "id", give, "x").collect()
    assert sorted(got, key=str) == sorted(screening.draw_strata(df.repartition(13), "s", "id", give, "x").collect(), key=str)
    assert sum(x.s == "true" for x in got) == 12 and sum(x.s is None for x in got) == 4 and len(got) == 16


def test_stratified_points(spark):
    r = random.Random(3)
    rows = [(i, r.gauss(10 * (i % 3), 1), r.gauss(0, 1), r.gauss(5 * (i % 2), 1)) for i in range(600)] + [(999, None, 0.0, 0.0)]
    got = screening.stratified_points(spark.createDataFrame(rows, "id int, a double, b double, c double"), "id", ["a", "b", "c"], 60, axes=2, strata=6, least=5)
    per = {x.stratum: x["count"] for x in got.groupBy("stratum").count().collect()}
    assert got.count() == 60 == got.select("id").distinct().count() and len(per) == 6 and min(per.values()) >= 5


def plots(n=240):
    r = random.Random(4)
    return [(i, r.randrange(3), r.randrange(4), r.randrange(7), r.gauss(10, 3) if i % 40 else None) for i in range(n)]


def fit(rows, lam):
    m = np.mean([x[4] for x in rows])
    return lambda g: (sum(x[4] for x in rows if x[3] == g) + lam * m) / (sum(x[3] == g for x in rows) + lam)


def test_nested_validation(spark):
    rows = plots()
    df = spark.createDataFrame(rows, "id int, outer int, inner int, g int, y double")
    lams = [0.5, 4.0, 60.0]
    candidates = spark.createDataFrame(list(enumerate(lams, 1)), "candidate int, lam double")
    whole = [x for x in rows if x[4] is not None]
    got = {(x.fold, x.candidate): x for x in validation.inner_scores(validation.fold_sums(df), candidates).collect()}
    best = {}
    for o in range(3):
        train, scores = [x for x in whole if x[1] != o], []
        for c, lam in enumerate(lams, 1):
            rmse = []
            for i in range(4):
                f = fit([x for x in train if x[2] != i], lam)
                rmse.append(math.sqrt(np.mean([(x[4] - f(x[3])) ** 2 for x in train if x[2] == i])))
            scores.append(np.mean(rmse))
            assert got[o, c].score == pytest.approx(scores[-1])
        best[o] = lams[int(np.argmin(scores))]
        assert [got[o, c].chosen for c in (1, 2, 3)] == [lam == best[o] for lam in lams]
    oof = {x.id: x for x in validation.out_of_fold(df, ["id"], candidates).collect()}
    assert oof.keys() == {x[0] for x in whole}
    for i, o, _, g, y in whole[::11]:
        assert (oof[i].fold, oof[i].lam, oof[i].observed) == (o, best[o], y)
        assert oof[i].prediction == pytest.approx(fit([x for x in whole if x[1] != o], best[o])(g))


def test_latin_hypercube(spark):
    got = validation.latin_hypercube(spark, 30, 4, "k").toPandas()
    assert list(got.columns) == ["candidate", "u1", "u2", "u3", "u4"]
    for j in range(1, 5):
        assert sorted(np.floor(got[f"u{j}"] * 30).astype(int)) == list(range(30))
    assert abs(np.corrcoef(got[["u1", "u2", "u3", "u4"]].T.to_numpy())[0, 1:]).max() < 0.6


def test_contract(spark):
    rows = [(k, s, k % 2, float(k), 1.0, "raw") for k in range(8) for s in ("a", "b")]
    schema = "id int, scenario string, fold int, observed double, prediction double, kind string"
    count = lambda rows: {x.fault: x.n for x in validation.contract_faults(spark.createDataFrame(rows, schema), "id", ["a", "b"]).collect() if x.n}
    assert count(rows) == {}
    assert count(rows[1:]) == {"missing scenario": 1} and count([*rows, rows[0]]) == {"repeated row": 1}
    assert count([*rows[1:], (0, "a", 1, 9.0, math.nan, "qm")]) == {"not finite": 1, "not raw": 1, "observations differ": 1, "folds differ": 1}
    assert count([*rows, (3, "c", 1, 3.0, 1.0, None)]) == {"unknown scenario": 1, "not raw": 1}
    m = validation.metrics(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double"), "y", "p").first()
    assert (m.n, m.r2, m.rmse, m.mae) == (3, pytest.approx(1 - 2 / (14 / 3)), pytest.approx(math.sqrt(2 / 3)), pytest.approx(2 / 3))


def test_fits_deal_lines_by_their_number(spark, monkeypatch):
    """Tasks of a fit grow in number with the lines, not in size."""
    from veldt.queries import relational

    monkeypatch.setattr(relational, "FIT_ROWS", 500)
    held = relational.features(spark, "/root/testdata/sf0.001")
    n = held.count()
    sizes = held.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == n and len(sizes) == -(-n // 500) and max(sizes) < 1000
