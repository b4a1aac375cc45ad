"""Exact nearest neighbours in a space of a few dimensions, without comparing all pairs.

Sites are dealt to cells of about CELL each by the splits of a k-d tree, which come from a sample of them; any splits
give the same result. Each place asked from first meets the cell whose box is nearest to it. The distance found there
bounds the search: only cells whose box is within it can hold anything nearer, and the place is sent to these alone.
Places are sent in slices, so neither a cell nor a slice grows with the data, and pairs of places are compared inside a
task and never become rows. Sites and queries at one place are one row, so that a place which many rows share costs no
more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.sources.shared import cut

#: Sites of a cell, on average, and cells at most: their boxes travel with the tasks (16 bytes a cell and dimension).
CELL, MOST_CELLS = 1024, 4096
#: Sites a cell that the splits are chosen from; they reach the driver.
SAMPLE = 16
#: Places that are sent to a cell at a time, on average.
SLICE = 4096
#: Entries of a distance matrix that a task holds at a time.
MATRIX = 1 << 20
SLACK = 1e-9


def _places(df: DataFrame, cols: list[str], to: str, group: str | None, name: str | None = None) -> DataFrame:
    """One row a place (and group) with finite coordinates: to0 .., g, and the least ``name``."""
    xs = [F.col(c).cast("double").alias(f"{to}{i}") for i, c in enumerate(cols)]
    g = F.col(group) if group else F.lit(None).cast("long")
    rows = df.select(*xs, g.alias("g"), *([F.col(name).alias("id")] if name else []))
    for i in range(len(cols)):
        rows = rows.filter(F.col(f"{to}{i}").isNotNull() & ~F.isnan(f"{to}{i}") & (F.abs(f"{to}{i}") < float("inf")))
    keys = [*[f"{to}{i}" for i in range(len(cols))], "g"]
    return rows.groupBy(*keys).agg(F.min("id").alias("id")) if name else rows.distinct()


def splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of the 2^depth - 1 inner nodes of a k-d tree, level by level: medians along the widest side."""
    dim, at, parts = [], [], [sample]
    for _ in range(depth):
        below = []
        for p in parts:
            k = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
            m = float(np.median(p[:, k])) if len(p) else 0.0
            dim.append(k)
            at.append(m)
            below += [p[p[:, k] <= m], p[p[:, k] > m]]
        parts = below
    return np.array(dim, np.int64), np.array(at)


def leaf(x: np.ndarray, dim: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row of x."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, dim[node]] > at[node])
    return (node - (2**depth - 1)).astype(np.int32)


class Pivots:
    """Distances to the sites of a cell, a bounded block of rows at a time; with the places' groups, infinite to a site of the own group."""

    def __init__(self, points: np.ndarray, groups: list):
        self.points = points
        self.code = {g: i for i, g in enumerate(dict.fromkeys(g for g in groups if not pd.isna(g)))}
        self.groups = np.array([-2 if pd.isna(g) else self.code[g] for g in groups])

    def blocks(self, x: np.ndarray, groups: pd.Series | None = None) -> Iterator[tuple[slice, np.ndarray]]:
        own = np.array([self.code.get(g, -1) for g in groups], np.int64) if groups is not None else None
        step = max(1, MATRIX // max(1, len(self.points)))
        for a in range(0, len(x), step):
            part = x[a : a + step]
            d = np.zeros((len(part), len(self.points)))
            for k in range(x.shape[1]):
                gap = part[:, k, None] - self.points[None, :, k]
                d += gap * gap
            np.sqrt(d, out=d)
            if own is not None:
                d[own[a : a + step, None] == self.groups[None, :]] = np.inf
            yield slice(a, a + len(part)), d


class Boxes:
    """Distances from places to the boxes of the cells; infinite to a cell whose sites are all of the place's own group."""

    def __init__(self, low: np.ndarray, high: np.ndarray, only: list):
        self.low, self.high = low, high
        self.code = {g: i for i, g in enumerate(dict.fromkeys(g for g in only if g is not None))}
        self.only = np.array([-2 if g is None else self.code[g] for g in only])

    def blocks(self, x: np.ndarray, groups: pd.Series) -> Iterator[tuple[slice, np.ndarray]]:
        own = np.array([self.code.get(g, -1) for g in groups], np.int64)
        step = max(1, MATRIX // max(1, len(self.low)))
        for a in range(0, len(x), step):
            part, d = x[a : a + step], np.zeros((len(x[a : a + step]), len(self.low)))
            for k in range(x.shape[1]):
                out = np.maximum(np.maximum(self.low[None, :, k] - part[:, k, None], part[:, k, None] - self.high[None, :, k]), 0.0)
                d += out * out
            d[own[a : a + step, None] == self.only[None, :]] = np.inf
            yield slice(a, a + len(part)), np.sqrt(d)


def met(sent: DataFrame, placed: DataFrame, dims: int) -> DataFrame:
    """a0.., g, u, cell, id, distance: the nearest site of another group (least id on ties) in the cell that each place is sent to.

    sent: a0.., g, u, cell, checkpointed; placed: s0.., g, id, cell. A cell that more than SLICE places are sent to
    meets them in slices. A place that finds none has a null id.
    """
    a, s = [f"a{i}" for i in range(dims)], [f"s{i}" for i in range(dims)]
    kind, id_kind = sent.schema["g"].dataType.simpleString(), placed.schema["id"].dataType.simpleString()

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = x[[*a, "g", "u", "cell"]].assign(id=None, distance=np.nan)
        if not len(x) or not len(y):
            return out
        y = y.sort_values("id", kind="stable")
        best, least = np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, d in Pivots(y[s].to_numpy(float), list(y["g"])).blocks(x[a].to_numpy(float), x["g"]):
            best[i], least[i] = d.argmin(1), d.min(1)
        found = np.isfinite(least)
        ids = y["id"].to_numpy(object)[best]
        ids[~found] = None
        return out.assign(id=ids, distance=np.where(found, least, np.nan))

    counts = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    asked = sent.join(F.broadcast(counts), "cell").select(*a, "g", "u", "cell", F.pmod(F.xxhash64(*a, "g"), F.col("slices")).cast("int").alias("slice"))
    held = placed.join(F.broadcast(counts), "cell").select(*s, "g", "id", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    row = f"{', '.join(f'{c} double' for c in a)}, g {kind}, u double, cell int, id {id_kind}, distance double"
    pairs = asked.groupBy("cell", "slice").cogroup(held.groupBy("cell", "slice")).applyInPandas(compare, row)
    return pairs.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def search(asks: DataFrame, sites: DataFrame, dims: int) -> DataFrame:
    """a0.., g, nn, distance: for each place asked from, the nearest site of another group (least id on ties).

    asks: a0.., g; sites: s0.., g, id; both one row a place and group, and sites checkpointed. A null group is no group.
    An ask for which there is no site has no row.
    """
    a, s = [f"a{i}" for i in range(dims)], [f"s{i}" for i in range(dims)]
    kind, id_kind = asks.schema["g"].dataType.simpleString(), sites.schema["id"].dataType.simpleString()
    n = sites.count()
    if n == 0:
        return asks.limit(0).select(*a, "g", F.lit(None).cast(id_kind).alias("nn"), F.lit(None).cast("double").alias("distance"))
    depth = int(np.ceil(np.log2(min(MOST_CELLS, max(1.0, n / CELL)))))
    chosen = sites.filter(F.pmod(F.xxhash64(*s, "id"), F.lit(n)) < SAMPLE * 2**depth).select(*s).collect() if depth else []
    dim, at = splits(np.array([list(r) for r in chosen]).reshape(-1, dims), depth)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=leaf(b[s].to_numpy(float), dim, at, depth))

    placed = sites.select(*s, "g", "id").mapInPandas(home, f"{', '.join(f'{c} double' for c in s)}, g {kind}, id {id_kind}, cell int")
    edges = [f(c).alias(f"{name}_{c}") for c in s for name, f in (("low", F.min), ("high", F.max))]
    one = F.when((F.count("g") == F.count(F.lit(1))) & (F.min("g") == F.max("g")), F.min("g")).alias("only")
    cells = placed.groupBy("cell").agg(*edges, one).orderBy("cell").collect()
    number = np.array([r.cell for r in cells], np.int32)
    boxes = Boxes(np.array([[r[f"low_{c}"] for c in s] for r in cells]), np.array([[r[f"high_{c}"] for c in s] for r in cells]), [r.only for r in cells])
    middle = (boxes.low + boxes.high) / 2

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, u, x = np.zeros(len(b), np.int32), np.zeros(len(b)), b[a].to_numpy(float)
            for i, d in boxes.blocks(x, b["g"]):
                best = d.argmin(1)
                inside = (d == 0).sum(1) > 1  # of the boxes around a place the one whose middle is nearest
                if inside.any():
                    off = ((x[i][inside, None, :] - middle[None]) ** 2).sum(2)
                    best[inside] = np.where(d[inside] == 0, off, np.inf).argmin(1)
                cell[i], u[i] = number[best], d.min(1)
            yield b.assign(u=np.inf, cell=cell)[np.isfinite(u)]

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, d in boxes.blocks(b[a].to_numpy(float), b["g"]):
                part = b.iloc[i]
                near = (d <= part["u"].to_numpy()[:, None] * (1 + SLACK)) & np.isfinite(d) & (number[None, :] != part["cell"].to_numpy()[:, None])
                row, cell = np.nonzero(near)
                yield part.iloc[row].assign(cell=number[cell])[[*a, "g", "u", "cell"]]

    row = f"{', '.join(f'{c} double' for c in a)}, g {kind}, u double, cell int"
    at_home = cut(met(cut(asks.select(*a, "g").mapInPandas(first, row)), placed, dims))
    every = at_home
    if len(cells) > 1:
        abroad = at_home.select(*a, "g", F.coalesce("distance", F.lit(float("inf"))).alias("u"), "cell").mapInPandas(others, row)
        every = at_home.union(met(cut(abroad), placed, dims))
    best = every.filter("distance is not null").groupBy(*a, "g").agg(F.min(F.struct("distance", "id")).alias("best"))
    return best.select(*a, "g", F.col("best.id").alias("nn"), F.col("best.distance").alias("distance"))


def nearest(queries: DataFrame, points: DataFrame, cols: list[str], point_id: str, group: str | None = None) -> DataFrame:
    """queries with nn and distance: the nearest of points in ``cols``, of another ``group`` if one is named.

    Ties go to the least id. Both are null for a query with a missing or infinite coordinate, or without any point
    to go to; such points are not found. Points of null group are anybody's. queries are checkpointed: they are read
    twice, and a mean taken again in another order would not meet its own place.
    """
    queries = cut(queries)
    found = search(_places(queries, cols, "a", group), cut(_places(points, cols, "s", group, point_id)), len(cols))
    on = [F.col(f"l.{c}").cast("double") == F.col(f"r.a{i}") for i, c in enumerate(cols)]
    if group:
        on.append(F.col(f"l.{group}").eqNullSafe(F.col("r.g")))
    return queries.alias("l").join(found.alias("r"), reduce(lambda x, y: x & y, on), "left").select("l.*", "r.nn", "r.distance")


def nearest_other(points: DataFrame, cols: list[str], point_id: str) -> DataFrame:
    """points with ``distance`` to the nearest row of another id; 0 where another shares the place, null as in nearest()."""
    points = cut(points)  # read twice, as in nearest()
    xs = [F.col(c).cast("double").alias(f"a{i}") for i, c in enumerate(cols)]
    there = reduce(lambda x, y: x & y, [F.col(f"a{i}").isNotNull() & ~F.isnan(f"a{i}") & (F.abs(f"a{i}") < float("inf")) for i in range(len(cols))])
    keys = [f"a{i}" for i in range(len(cols))]
    places = cut(points.select(*xs, F.col(point_id).alias("id")).filter(there).groupBy(*keys).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    asks = places.filter("n = 1").select(*keys, F.col("id").alias("g"))
    sites = places.select(*[F.col(k).alias(f"s{i}") for i, k in enumerate(keys)], F.col("id").alias("g"), "id")
    single = search(asks, sites, len(cols)).select(*keys, "distance")
    every = places.filter("n > 1").select(*keys, F.lit(0.0).alias("distance")).union(single)
    on = [F.col(f"l.{c}").cast("double") == F.col(f"r.a{i}") for i, c in enumerate(cols)]
    return points.alias("l").join(every.alias("r"), reduce(lambda x, y: x & y, on), "left").select("l.*", "r.distance")
