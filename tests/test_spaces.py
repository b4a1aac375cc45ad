"""Order statistics by ranges, nearest neighbours, polygons, applicability, folds and forests against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import applicability, fdr, forest, nearest, polygons, ranges


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles(many_parts):
    r = random.Random(1)
    rows = [(g, r.choice((r.uniform(-5, 5), 1.0, 2.0, None))) for g in ("a", "b", None) for _ in range(80)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    shares = [0.0, 0.05, 0.25, 0.5, 0.975, 1.0]
    got = {(x.g, x.share): x.q for x in ranges.quantiles(many_parts.createDataFrame(rows, "g string, v double"), "v", shares, ["g"]).collect()}
    want = {(g, s): float(np.quantile([v for h, v in rows if h == g and v is not None], s)) for g in ("a", "b", None, "one", "two") for s in shares}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)
    assert ranges.quantiles(many_parts.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_count_at_least(many_parts):
    r = random.Random(2)
    null = [(r.choice((0.5, 1.0, math.inf, r.random())),) for _ in range(200)]
    seen = [(i, r.choice((0.5, 1.0, math.inf, 2.0, r.random(), None))) for i in range(90)]
    got = ranges.count_at_least(many_parts.createDataFrame(seen, "cell int, stat double"), many_parts.createDataFrame(null, "stat double")).collect()
    assert {x.cell: x.k for x in got} == {i: None if v is None else sum(n >= v for (n,) in null) for i, v in seen}


def test_count_at_least_by_group(many_parts):
    r = random.Random(21)
    null = [(r.choice(("a", "b", None)), float(r.randrange(9))) for _ in range(150)]
    seen = [(i, r.choice(("a", "b", None, "none")), r.choice((float(r.randrange(9)), None))) for i in range(60)]
    got = ranges.count_at_least(many_parts.createDataFrame(seen, "i int, g string, stat double"), many_parts.createDataFrame(null, "g string, stat double"), by=["g"]).collect()
    assert {x.i: x.k for x in got} == {i: None if v is None else sum(h == g and n >= v for h, n in null) for i, g, v in seen}


def test_levels_over_ranges(many_parts):
    """One family far larger than a range, by the step-up rule."""
    r = random.Random(3)
    p = [round(r.random() ** 3, 3) for _ in range(600)] + [None, 0.0, 1.0]
    df = many_parts.createDataFrame([(i, "f" if i % 7 else None, v) for i, v in enumerate(p)], "id int, fam string, p double")
    got = {x.id: (x.q_bh, x.q_by) for x in fdr.adjust(df, ["fam"]).collect()}
    for fam in (True, False):
        own = sorted((v, i) for i, v in enumerate(p) if v is not None and bool(i % 7) == fam)
        low, m = 1.0, len(own)
        h = sum(1 / k for k in range(1, m + 1))
        for k in range(m, 0, -1):
            low = min(low, own[k - 1][0] * m / k)
            assert math.isclose(got[own[k - 1][1]][0], low, abs_tol=1e-12) and math.isclose(got[own[k - 1][1]][1], min(1, low * h), abs_tol=1e-12)
    assert got[600] == (None, None)


POINTS = "id long, x double, y double, g string, cell string, r string"


def points(spark, rows):
    return spark.createDataFrame([(*r, "c", "r") for r in rows], POINTS)


@pytest.fixture(scope="module")
def cloud():
    r = random.Random(5)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 30), r.choice("abc")) for i in range(300)]
    rows += [(1000 + i, 0.25, 0.5, "a") for i in range(150)]  # one place, a third of all rows
    rows += [(2000 + i, r.uniform(900, 901), 5.0, "b") for i in range(40)] + [(3000, None, 1.0, "a"), (3001, math.nan, 1.0, "b"), (3002, math.inf, 0.0, None), (3003, 0.25, 0.5, None), (3004, 1.5, 1.5, None)]
    return rows


def usable(row):
    return all(v is not None and math.isfinite(v) for v in row[1:3])


def test_nearest(spark, cloud):
    asks = cloud[::3] + [(9000, 450.0, 0.0, "a"), (9001, -1e6, 1e6, "zz"), (9002, 0.25, 0.5, None), (9003, 0.25, 0.5, "a"), (9003, 0.25, 0.5, "a")]
    for group in (None, "g"):
        got = nearest.nearest(points(spark, asks), points(spark, cloud), ["x", "y"], "id", group).collect()
        assert len(got) == len(asks) and got[0].__fields__ == ["id", "x", "y", "g", "cell", "r", "nn", "distance"]
        found = {x.id: (x.nn, x.distance) for x in got}
        for a in asks:
            best = min(((math.sqrt((a[1] - p[1]) ** 2 + (a[2] - p[2]) ** 2), p[0]) for p in cloud if usable(p) and not (group and a[3] is not None and a[3] == p[3])), default=None) if usable(a) else None
            assert found[a[0]] == ((None, None) if best is None else (best[1], pytest.approx(best[0])))


def test_nearest_edges(spark, cloud):
    few, none = points(spark, cloud[:5]), points(spark, [])
    assert nearest.nearest(few, none, ["x", "y"], "id").filter("nn is null and distance is null").count() == 5
    assert nearest.nearest(none, few, ["x", "y"], "id").count() == 0
    one_group = points(spark, [(i, float(i), 0.0, "a") for i in range(4)])
    assert nearest.nearest(one_group, one_group, ["x", "y"], "id", "g").filter("distance is null").count() == 4
    got = {x.id: x.distance for x in nearest.nearest_other(points(spark, cloud), ["x", "y"], "id").collect()}
    for a in cloud[::7] + cloud[-5:]:
        others = [math.hypot(a[1] - p[1], a[2] - p[2]) for p in cloud if p[0] != a[0] and usable(p)] if usable(a) else []
        assert got[a[0]] == (pytest.approx(min(others)) if others else None)
    assert nearest.nearest_other(points(spark, cloud[:1]), ["x", "y"], "id").first().distance is None


def test_nearest_of_many(spark):
    """Thousands of places against plain distances, and a distance matrix that is never held whole."""
    r = np.random.default_rng(6)
    xy = r.random((3000, 2)) ** 3
    df = points(spark, [(i, float(x), float(y), "a") for i, (x, y) in enumerate(xy)])
    got = {x.id: x.distance for x in nearest.nearest_other(df, ["x", "y"], "id").collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert np.allclose([got[i] for i in range(3000)], d.min(1))
    held = nearest.Pivots(np.zeros((64, 2)), [None] * 64)
    assert all(m.size <= nearest.MATRIX for _, m in held.blocks(np.zeros((200_000, 2))))


def test_nearest_pairs_are_no_rows(spark, monkeypatch):
    """A place sent to a cell is one row, whatever the cell holds; many cells and slices of them against plain distances."""
    monkeypatch.setattr(nearest, "SLICE", 50)
    monkeypatch.setattr(nearest, "CELL", 40)
    r = np.random.default_rng(7)
    xy = r.random((900, 2))
    group = (xy[:, 0] * 3).astype(int)  # whole cells of one group
    rows = [(i, float(x), float(y), int(g)) for i, ((x, y), g) in enumerate(zip(xy, group, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double, g long")
    sent = spark.createDataFrame([(x, y, g, math.inf, 0) for _, x, y, g in rows], "a0 double, a1 double, g long, u double, cell int")
    one = nearest.met(sent, df.selectExpr("x s0", "y s1", "g", "id", "0 cell"), 2).collect()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    d[group[:, None] == group[None]] = np.inf
    assert len(one) == 900 and sorted(x.distance for x in one) == pytest.approx(sorted(d.min(1)))
    got = {x.id: (x.nn, x.distance) for x in nearest.nearest(df, df, ["x", "y"], "id", "g").collect()}
    assert all(got[i] == (d[i].argmin(), pytest.approx(d[i].min())) for i in range(900))


def test_matched_folds_meet_new_places_once(spark, monkeypatch):
    """The distances of prediction are found once for all tries."""
    r = random.Random(3)
    train, new = (points(spark, [(i, r.random(), r.random(), "a") for i in range(n)]) for n in (120, 60))
    seen = []
    monkeypatch.setattr(applicability, "nearest", lambda q, p, *a: seen.append(q is new) or nearest.nearest(q, p, *a))
    folds, tried = applicability.matched_folds(train, new, ["x", "y"], "id", tries=(8, 16))
    assert folds.count() == 120 and len(tried) > 1 and sum(seen) == 1


def restless(spark, n):
    """id and a value that is another one each time it is computed, as sums in another order are."""
    from pyspark.sql import functions as F

    other = F.udf(lambda i: i + random.random(), "double").asNondeterministic()
    return spark.range(n).select("id", other("id").alias("x"))


def test_counts_meet_values_that_are_computed_once(spark):
    reference = spark.range(20).selectExpr("double(id) x")
    got = ranges.count_at_least(restless(spark, 20), reference, "x").collect()
    assert sorted(r.k for r in got) == list(range(20))


def test_nearest_meets_places_that_are_computed_once(spark):
    sites = spark.range(25).selectExpr("id", "double(id) x")
    assert nearest.nearest(restless(spark, 20), sites, ["x"], "id").filter("distance is null").count() == 0
    assert nearest.nearest_other(restless(spark, 20), ["x"], "id").filter("distance is null").count() == 0


RINGS = [
    ("square", "outer", [(0, 0), (10, 0), (10, 10), (0, 10)]),
    ("square", "hole", [(3, 3), (7, 3), (7, 7), (3, 7)]),
    ("wedge", "outer", [(5, -3), (18.5, 4), (6.2, 12)]),
    ("far", "outer", [(-20, -20), (-12, -20), (-16, -11)]),
    ("star", "outer", [(0, 20), (10, 26), (0, 32), (4, 26)]),
    ("same", "outer", [(0, 0), (10, 0), (10, 10), (0, 10)]),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(p, ring, k, float(x), float(y)) for p, ring, c in RINGS for k, (x, y) in enumerate(c)]
    return polygons.edges_of(spark.createDataFrame(rows, "poly string, ring string, k int, x double, y double"), "poly", ["ring"], "k", "x", "y")


def inside(poly, x, y):
    n = 0
    for p, _, c in RINGS:
        if p == poly:
            for (x0, y0), (x1, y1) in zip(c, [*c[1:], c[0]], strict=True):
                n += (y0 > y) != (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0)
    return n % 2 == 1


@pytest.mark.parametrize("size", [0.7, 4.0, 100.0])
def test_within(spark, edges, size):
    r = random.Random(7)
    pts = [(i, r.uniform(-22, 22), r.uniform(-22, 34)) for i in range(800)] + [(900 + i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 10), (3, 3), (5, 5), (0, 5), (10, 5), (5, 0), (5, 10), (4, 26)])] + [(990, None, 1.0), (991, 1.0, None)]
    got = sorted((x.i, x.poly) for x in polygons.within(spark.createDataFrame(pts, "i int, px double, py double"), edges, "px", "py", size).collect())
    assert got == sorted((i, p) for i, x, y in pts if x is not None and y is not None for p in sorted({p for p, _, _ in RINGS}) if inside(p, x, y))


@pytest.mark.parametrize("size", [0.9, 5.0, 64.0])
def test_union_area(spark, edges, size):
    from itertools import pairwise

    a = polygons.union_area(edges, size).first()
    single = 100 - 16 + 100 + 36 + 0.5 * abs((18.5 - 5) * (12 + 3) - (6.2 - 5) * (4 + 3)) + 0.5 * abs(10 * 12 - 0) - 0.5 * 4 * 12
    assert a.area_sum == pytest.approx(single)
    n, union, twice = 4000, 0.0, 0.0
    ys = np.linspace(-20.001, 32.001, n)
    for lo, hi in pairwise(ys):  # thin strips, exact along x
        y, events = (lo + hi) / 2, []
        for p in {p for p, _, _ in RINGS}:
            xs = sorted(x0 + (y - y0) / (y1 - y0) * (x1 - x0) for q, _, c in RINGS if q == p for (x0, y0), (x1, y1) in zip(c, [*c[1:], c[0]], strict=True) if (y0 > y) != (y1 > y))
            events += [(x, 1 if k % 2 == 0 else -1) for k, x in enumerate(xs)]
        deep, before = 0, 0.0
        for x, d in sorted(events, key=lambda e: (e[0], -e[1])):
            union, twice = union + (x - before) * (deep > 0) * (hi - lo), twice + (x - before) * (deep > 1) * (hi - lo)
            deep, before = deep + d, x
    assert a.area_union == pytest.approx(union, rel=1e-3) and a.area_shared == pytest.approx(twice, rel=1e-3)


def test_no_polygons(spark, edges):
    none = edges.limit(0)
    assert polygons.within(spark.createDataFrame([(1, 1.0, 1.0)], "i int, px double, py double"), none, "px", "py", 1.0).count() == 0
    assert tuple(polygons.union_area(none, 1.0).first()) == (0.0, 0.0, 0.0)


def test_wasserstein(many_parts):
    r = random.Random(9)
    a, b = [r.random() for _ in range(70)], [r.random() ** 2 * 3 for _ in range(45)]
    to = lambda v: many_parts.createDataFrame([(x,) for x in [*v, None]], "distance double")
    grid = np.sort(np.array(a + b))
    fa, fb = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    assert applicability.wasserstein(to(a), to(b)).first().w == pytest.approx(float((np.abs(fa - fb)[:-1] * np.diff(grid)).sum()))
    assert applicability.wasserstein(to(a), to(a)).first().w == 0


def test_applicability(spark):
    r = random.Random(10)
    train = [(i, r.gauss(5, 2), r.gauss(0, 1), 7.0, i % 4) for i in range(120)] + [(500, None, 1.0, 7.0, 1)]
    new = [(i, r.gauss(5, 3), r.gauss(0, 2), 7.0) for i in range(60)] + [(98, 1e5, 0.0, 7.0), (99, None, 0.0, 7.0)]
    w = applicability.weights({"a": 3.0, "b": 1.0, "c": math.nan})
    assert sum(w.values()) == pytest.approx(3) and w["c"] == 0 and applicability.weights({"a": -1.0, "b": 0.0}) == {"a": 1.0, "b": 1.0}
    got = {x.i: x for x in applicability.area_of_applicability(spark.createDataFrame(train, "i long, a double, b double, c double, f int"), spark.createDataFrame(new, "i long, a double, b double, c double"), ["a", "b", "c"], "i", "f", w).collect()}
    t = np.array([x[1:3] for x in train[:-1]])
    every = np.array([x[2] for x in train])
    mean, sd = np.array([t[:, 0].mean(), every.mean()]), np.array([t[:, 0].std(ddof=1), every.std(ddof=1)])
    z = lambda v: (v - mean) / sd * np.array([w["a"], w["b"]])
    zt = z(t)
    d = np.sqrt(((zt[:, None] - zt[None]) ** 2).sum(-1))
    scale = d[~np.eye(len(d), dtype=bool)].mean()
    fold = np.array([x[4] for x in train[:-1]])
    own = np.where(fold[:, None] == fold[None], np.inf, d).min(1) / scale
    q1, q3 = np.quantile(own, [0.25, 0.75])
    limit = own[own <= q3 + 1.5 * (q3 - q1)].max()
    for i, a, b, _ in new[:-1]:
        di = np.sqrt(((z(np.array([a, b])) - zt) ** 2).sum(-1)).min() / scale
        assert got[i].di == pytest.approx(di) and got[i].threshold == pytest.approx(limit) and got[i].inside == (di <= limit)
    assert got[99].di is None and got[99].inside is None and not got[98].inside


def test_mean_distance_is_over_every_pair(spark, monkeypatch):
    """Rows beyond any 500 anchors count, at one place too, in any number of blocks; rows without a key do not."""
    r = random.Random(15)
    far = sorted(range(700), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[500:]
    rows = [(i, 50 + r.random() if i in far else round(r.gauss(0, 1), 1), r.gauss(0, 3)) for i in range(700)] + [(700 + i, 1.0, 2.0) for i in range(9)] + [(None, 1e6, 0.0)]
    z = np.array([x[1:] for x in rows[:-1]])
    want = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)).sum() / (len(z) * (len(z) - 1))
    df = spark.createDataFrame(rows, "i long, z0 double, z1 double")
    assert applicability.mean_distance(df, 2, "i") == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(applicability, "LEAST", 100)
    assert applicability.mean_distance(df, 2, "i") == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(applicability, "TILE", (16, 32))
    one = np.ones(len(z))
    assert applicability.sum_of_distances(z.T, one, z.T, one) == pytest.approx(want * len(z) * (len(z) - 1), rel=1e-12)
    assert applicability.mean_distance(df.filter("i < 1"), 2, "i") is None and applicability.mean_distance(df.limit(0), 2, "i") is None


def test_area_of_applicability_by_every_pair(spark):
    """di of new rows and the threshold follow training rows that no sample of 500 holds; the summary counts with them."""
    r = random.Random(16)
    far = set(sorted(range(600), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[500:])
    train = [(i, 9.0 + r.random() if i in far else r.random(), i % 3) for i in range(600)]
    t = np.array([x[1] for x in train])
    zt = (t - t.mean()) / t.std(ddof=1)
    d = np.abs(zt[:, None] - zt[None])
    scale, fold = d.sum() / (600 * 599), np.array([x[2] for x in train])
    own = np.where(fold[:, None] == fold[None], np.inf, d).min(1) / scale
    q1, q3 = np.quantile(own, [0.25, 0.75])
    limit = own[own <= q3 + 1.5 * (q3 - q1)].max()
    new = [(i, r.uniform(-1, 11)) for i in range(40)]
    di = {i: np.abs((v - t.mean()) / t.std(ddof=1) - zt).min() / scale for i, v in new}
    aoa = applicability.area_of_applicability(spark.createDataFrame(train, "i long, a double, f int"), spark.createDataFrame(new, "i long, a double"), ["a"], "i", "f")
    got = applicability.applicability_summary(aoa.withColumn("g", F.lit(1)), ["g"]).first()
    assert got.valid_cells == 40 and got.inside_cells == sum(v <= limit for v in di.values()) and aoa.first().threshold == pytest.approx(limit)
    assert got.di_mean == pytest.approx(np.mean(list(di.values()))) and got.di_max == pytest.approx(max(di.values()))


def test_matched_folds(spark):
    """Clustered data and far places: matched folds are nearer to the task than hashed ones, and sound."""
    r = random.Random(11)
    train = [(i, 10 * (i % 9) + r.random(), 10 * (i % 7) + r.random()) for i in range(300)]
    new = [(i, r.uniform(0, 150), r.uniform(0, 130)) for i in range(200)]
    df = spark.createDataFrame(train, "i long, x double, y double")
    folds, seen = applicability.matched_folds(df, spark.createDataFrame(new, "p long, x double, y double"), ["x", "y"], "i", tries=(16, 60))
    assert min(w for q, w in seen if q) < dict(seen)[0]
    assert tuple(applicability.fold_faults(folds, "i", 5).first()) == (0, 0, 0, 0) and folds.count() == 300
    bad = spark.createDataFrame([(1, 0), (1, None), (2, 7)], "i long, fold int")
    assert tuple(applicability.fold_faults(bad, "i", 5).first()) == (1, 1, 3, 1)


def test_forest_quantiles(spark):
    """Against a forest of the same leaves in plain Python."""
    r = random.Random(12)
    train = [(t, r.randrange(4), r.choice((float(r.randrange(9)), None))) for t in range(5) for _ in range(60)]
    rows = [(i, t, r.randrange(5)) for i in range(40) for t in range(5)] + [(100, t, 9) for t in range(5)]  # leaf 4 and 9 hold nothing
    rows += [(101, t, leaf) for i, t, leaf in rows if i == 0]
    got = {x.i: x for x in forest.quantiles(spark.createDataFrame(train, "tree int, leaf long, y double"), spark.createDataFrame(rows, "i int, tree int, leaf long"), ["i"], "y", {"lo": 0.05, "mid": 0.5, "hi": 0.95}).collect()}
    for i in {x[0] for x in rows}:
        w = {}
        for j, t, leaf in rows:
            own = [y for a, b, y in train if a == t and b == leaf and y is not None]
            if j == i:
                for y in own:
                    w[y] = w.get(y, 0) + 1 / len(own)
        if not w:
            assert got[i].mean is None and got[i].mid is None
            continue
        total = sum(w.values())
        assert got[i].mean == pytest.approx(sum(y * v for y, v in w.items()) / total)
        for name, s in (("lo", 0.05), ("mid", 0.5), ("hi", 0.95)):
            upto = 0
            for y in sorted(w):
                upto += w[y]
                if upto >= total * s - 1e-9:
                    break
            assert got[i][name] == y
    assert got[0].asDict() | {"i": 101} == got[101].asDict()


def test_forest_quantiles_of_lists(spark):
    """Rows with their leaves as an array, and training rows as counts, as the long form has it."""
    r = random.Random(14)
    train = [(t, r.randrange(4), r.choice((float(r.randrange(9)), None)), 1 + r.randrange(3)) for t in range(3) for _ in range(50)]
    lists = [(i, [r.randrange(5) for _ in range(3)]) for i in range(30)] + [(100, [9, 9, 9])]
    shares = {"lo": 0.05, "mid": 0.5}
    long = spark.createDataFrame([x[:3] for x in train for _ in range(x[3])], "tree int, leaf long, y double")
    want = forest.quantiles(long, spark.createDataFrame([(i, t, leaf) for i, ls in lists for t, leaf in enumerate(ls)], "i int, tree int, leaf long"), ["i"], "y", shares).collect()
    short = spark.createDataFrame(train, "tree int, leaf long, y double, n long")
    got = {x.i: x for x in forest.quantiles_of_lists(short, spark.createDataFrame(lists, "i int, leaves array<bigint>"), "y", shares, "n").collect()}
    assert len(got) == len(want) == 31 and got[100].mean is None
    assert all((got[x.i].lo, got[x.i].mid) == (x.lo, x.mid) and got[x.i].mean == (x.mean and pytest.approx(x.mean)) for x in want)


def test_quantile_forest_beats_constants(spark):
    r = random.Random(13)
    rows = [(i, x := r.uniform(0, 10), r.uniform(0, 1), round(x * 3 + r.gauss(0, 1 + x / 3), 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, x double, z double, y double")
    train, test = df.filter("i % 3 > 0"), df.filter("i % 3 = 0")
    model = forest.fit_forest(train, ["x", "z"], "y", trees=12, depth=6, least=15)
    shares = {"lo": 0.05, "mid": 0.5, "hi": 0.95}
    found = forest.quantiles(forest.leaf_rows(train, model, ["x", "z"], ["y"]), forest.leaf_rows(test, model, ["x", "z"], ["i"]), ["i"], "y", shares).join(test, "i")
    flat = {n: train.agg(F.percentile("y", s)).first()[0] for n, s in shares.items()}
    constant = test.withColumns({n: F.lit(v) for n, v in flat.items()})
    for n, s in shares.items():
        assert found.agg(forest.pinball(found, "y", n, s)).first()[0] < 0.6 * constant.agg(forest.pinball(constant, "y", n, s)).first()[0]
    inside_band = found.agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("int"))).first()[0]
    assert 0.8 < inside_band < 0.98
