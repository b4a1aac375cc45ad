"""Grids with several bands: alignment to a template, sampling at points, cell areas, and spectral windows.

A grid is a table (row, col, bands) with a geometry: the corner of its first cell and the size of a cell, rows
counted downwards. A cell is valid if all its bands are; other cells may be absent or null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The equatorial radius (m) and the flattening of the reference ellipsoid.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563


@dataclass(frozen=True)
class Geometry:
    """Left and top edge, width and height of a cell, in map units."""

    left: float
    top: float
    width: float
    height: float

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.left + (col + 0.5) * self.width, self.top - (row + 0.5) * self.height

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) as fractions: whole numbers are edges of cells."""
        return (self.top - y) / self.height, (x - self.left) / self.width


def _valid(bands: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double")) for b in bands])


def at_points(points: DataFrame, grid: DataFrame, geometry: Geometry, bands: list[str]) -> DataFrame:
    """points (with x, y) and the bands of the cell that each lies in; null outside the grid or where x or y is null.

    A point on an edge belongs to the cell to its right and below. Repeated points stay; columns of points that are
    named like a band are an error.
    """
    row, col = geometry.place(F.col("x"), F.col("y"))
    placed = points.withColumns({"__row": F.floor(row), "__col": F.floor(col)})
    cells = grid.select(F.col("row").cast("long").alias("__row"), F.col("col").cast("long").alias("__col"), *bands)
    return placed.join(cells, ["__row", "__col"], "left").drop("__row", "__col")


def align(source: DataFrame, frm: Geometry, template: DataFrame, to: Geometry, bands: list[str], method: str = "bilinear", zero_is_missing: bool = True) -> DataFrame:
    """row, col and the bands on the template's grid, for the template's valid cells only.

    template is (row, col, v); a null, NaN or, unless told otherwise, zero v masks the cell. On equal geometries the
    cells are masked and nothing else. Otherwise ``near`` takes the source cell around a target's centre, and ``bilinear``
    the four cells around it by their weights, spread over the valid ones, each band for itself; a band with none
    is null. The mask is applied first, so masked cells meet no source.
    """
    if method not in ("near", "bilinear"):
        raise ValueError(f"unknown method {method}")
    v = F.col("v").cast("double")
    open_ = F.col("v").isNotNull() & ~F.isnan(v) & ((v != 0) if zero_is_missing else F.lit(True))
    mask = template.filter(open_).select("row", "col").distinct()
    if frm == to:
        return mask.join(source.select("row", "col", *bands), ["row", "col"], "left")
    row, col = frm.place(*to.centre(F.col("row"), F.col("col")))
    if method == "near":
        wanted = mask.select("row", "col", F.floor(row).alias("__row"), F.floor(col).alias("__col"), F.lit(1.0).alias("__w"))
    else:
        low = mask.select("row", "col", (row - 0.5).alias("__y"), (col - 0.5).alias("__x"))
        fy, fx = F.col("__y") - F.floor("__y"), F.col("__x") - F.floor("__x")
        four = F.array(*[F.struct((F.floor("__y") + dr).alias("r"), (F.floor("__x") + dc).alias("c"), ((fy if dr else 1 - fy) * (fx if dc else 1 - fx)).alias("w")) for dr in (0, 1) for dc in (0, 1)])
        wanted = low.select("row", "col", F.explode(four).alias("n")).filter("n.w > 0").select("row", "col", F.col("n.r").alias("__row"), F.col("n.c").alias("__col"), F.col("n.w").alias("__w"))
    cells = source.select(F.col("row").cast("long").alias("__row"), F.col("col").cast("long").alias("__col"), *bands)
    met = wanted.join(cells, ["__row", "__col"], "left")
    if method == "near":
        return met.select("row", "col", *bands)
    mean = lambda b: F.sum(F.when(_valid([b]), F.col("__w") * F.col(b))) / F.sum(F.when(_valid([b]), F.col("__w")))
    return met.groupBy("row", "col").agg(*[mean(b).alias(b) for b in bands])


def ellipsoid_area(south: Column, north: Column, width: Column) -> Column:
    """km2 of the ellipsoid between two latitudes (degrees) over ``width`` degrees of longitude, in closed form."""
    e2 = FLATTENING * (2 - FLATTENING)
    e, b = math.sqrt(e2), RADIUS * (1 - FLATTENING)

    def upto(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (1 - e2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)

    return b * b / 2 * F.radians(width) * (upto(north) - upto(south)) / 1e6


def resolution(grids: DataFrame) -> DataFrame:
    """grids and what their cells measure.

    grids has the affine terms a, b, d, e (x = a col + b row, y = d col + e row), kind ('projected', 'geographic' or null) and
    metres, the length of a map unit (null if it has none, as degrees have not). A grid without terms has nulls.
    """
    px, py = F.hypot("a", "d"), F.hypot("b", "e")
    flag = lambda k: F.coalesce((F.col("kind") == k).cast("int"), F.lit(0))
    return grids.withColumns({"size_x": px, "size_y": py, "cell_area": F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d")), "is_projected": flag("projected"), "is_geographic": flag("geographic"), "size_x_m": px * F.col("metres"), "size_y_m": py * F.col("metres")})


def geometry_faults(grids: DataFrame, like: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """grids and ``faults``: what differs from the one row of like, of system, shape, size and place; empty where they align.

    Both have crs, rows, cols, left, top, width, height. A null differs from everything but a null.
    """
    parts = {"system": ["crs"], "shape": ["rows", "cols"], "size": ["width", "height"], "place": ["left", "top"]}
    names = [c for cs in parts.values() for c in cs]
    near = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"__{c}"))), F.lit(False))
    same = {"crs": F.col("crs").eqNullSafe(F.col("__crs"))} | {c: near(c) for c in names if c != "crs"}
    one = like.select(*[F.col(c).alias(f"__{c}") for c in names]).limit(1)
    out = F.filter(F.array(*[F.when(~reduce(lambda a, b: a & b, [same[c] for c in cs]), F.lit(k)) for k, cs in parts.items()]), lambda k: k.isNotNull())
    return grids.join(F.broadcast(one)).withColumn("faults", F.concat_ws(",", out)).drop(*[f"__{c}" for c in names])


def around(grid: DataFrame, bands: list[str], radius: int) -> DataFrame:
    """row, col, dr, dc, bands: every valid cell as seen from each cell of the square around it."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)])
    sent = grid.filter(_valid(bands)).select("row", "col", *bands, F.explode(steps).alias("o"))
    return sent.select((F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col"), F.col("o.r").alias("dr"), F.col("o.c").alias("dc"), *bands)


def spectral_morphology(grid: DataFrame, bands: list[str], radius: int = 1) -> DataFrame:
    """row, col, {band}_dilation, {band}_erosion, {band}_gradient at every valid cell.

    Over the square window the spectrum that stands at the widest angle from the window's mean spectrum is the dilation, the one
    at the narrowest the erosion; cosines are compared to nine digits, and of equal ones the first of the window, row by row,
    is taken. A zero spectrum is at a right angle to all. One shuffle; a window's cells are one bounded array.
    """
    cell = F.struct("dr", "dc", F.array(*[F.col(b).cast("double") for b in bands]).alias("s"))
    seen = around(grid, bands, radius).groupBy("row", "col").agg(F.sort_array(F.collect_list(cell)).alias("w"), F.count_if((F.col("dr") == 0) & (F.col("dc") == 0)).alias("own"), *[F.avg(b).alias(f"__m{i}") for i, b in enumerate(bands)])
    mean = [F.col(f"__m{i}") for i in range(len(bands))]
    dot = lambda s, t: reduce(lambda a, b: a + b, [x * y for x, y in zip(s, t, strict=True)])

    def cosine(s: Column) -> Column:
        own = [F.get(s, F.lit(i)) for i in range(len(bands))]
        under = F.sqrt(dot(own, own) * dot(mean, mean))
        return F.round(F.when(under > 0, dot(own, mean) / under).otherwise(0.0), 9)

    ranked = lambda sign: F.array_min(F.transform("w", lambda x: F.struct((sign * cosine(x["s"])).alias("k"), x["dr"].alias("dr"), x["dc"].alias("dc"), x["s"].alias("s"))))["s"]
    found = seen.filter("own > 0").select("row", "col", ranked(1.0).alias("far"), ranked(-1.0).alias("near"))
    pick = lambda side, i: F.get(F.col(side), F.lit(i))
    return found.select("row", "col", *[c for i, b in enumerate(bands) for c in (pick("far", i).alias(f"{b}_dilation"), pick("near", i).alias(f"{b}_erosion"), (pick("far", i) - pick("near", i)).alias(f"{b}_gradient"))])


def spectral_spread(grid: DataFrame, bands: list[str], radius: int) -> DataFrame:
    """row, col, sg, sd at every valid cell: root mean square over the bands of their deviations, and of their ranges, in the square.

    Every cell is sent along its row and summed there, and the sums along the columns: 2 (2 radius + 1) rows a cell, combined
    before each shuffle, whatever cells are missing.
    """
    k = range(len(bands))
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("o")
    sent = grid.filter(_valid(bands)).select("row", "col", *bands, steps).withColumn("col", F.col("col") + F.col("o"))
    one = sent.groupBy("row", "col").agg(F.bool_or(F.col("o") == 0).alias("own"), F.count(F.lit(1)).alias("n"), *[c for i, b in enumerate(bands) for c in (F.sum(b).alias(f"s{i}"), F.sum(F.col(b) * F.col(b)).alias(f"q{i}"), F.min(b).alias(f"l{i}"), F.max(b).alias(f"h{i}"))])
    down = one.select("*", steps).withColumn("row", F.col("row") + F.col("o"))
    two = down.groupBy("row", "col").agg(F.bool_or(F.col("own") & (F.col("o") == 0)).alias("own"), F.sum("n").alias("n"), *[f(f"{x}{i}").alias(f"{x}{i}") for i in k for x, f in (("s", F.sum), ("q", F.sum), ("l", F.min), ("h", F.max))])
    var = lambda i: F.greatest(F.lit(0.0), F.col(f"q{i}") / F.col("n") - F.pow(F.col(f"s{i}") / F.col("n"), 2))
    rms = lambda parts: F.sqrt(reduce(lambda a, b: a + b, parts) / len(bands))
    return two.filter("own").select("row", "col", rms([var(i) for i in k]).alias("sg"), rms([F.pow(F.col(f"h{i}") - F.col(f"l{i}"), 2) for i in k]).alias("sd"))


#: The four directions of a co-occurrence.
DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1))


def texture(levels: DataFrame, size: int = 3) -> DataFrame:
    """row, col, contrast, dissimilarity, asm, entropy, variance, correlation of the grey levels v around every valid cell.

    In the square of side 2 size + 1 each direction's pairs of neighbours are counted both ways; each measure is taken for a
    direction and averaged over those with pairs. Correlation is null where no direction varies.
    A pair of cells is sent to the windows that hold both and counted by (window, direction, levels).
    """
    valid = levels.filter("v is not null").select("row", "col", F.col("v").alias("i"))
    dirs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (r, c) in enumerate(DIRECTIONS)])
    sent = valid.select("row", "col", "i", F.explode(dirs).alias("d")).select((F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"), F.col("d").alias("d"), "i")
    pairs = sent.join(valid.withColumnRenamed("i", "j"), ["row", "col"]).select("row", "col", "d", F.array_sort(F.array("i", "j")).alias("ij"))
    # centres whose window holds (row, col) and (row, col) - d
    lo = lambda c, s: F.col(c) - size - F.least(F.lit(0), F.col(f"d.{s}"))
    hi = lambda c, s: F.col(c) + size - F.greatest(F.lit(0), F.col(f"d.{s}"))
    wide = pairs.select("*", F.explode(F.sequence(lo("row", "r"), hi("row", "r"))).alias("wr")).select("*", F.explode(F.sequence(lo("col", "c"), hi("col", "c"))).alias("wc"))
    count = wide.groupBy(F.col("wr").alias("row"), F.col("wc").alias("col"), F.col("d.k").alias("k"), "ij").agg(F.count(F.lit(1)).alias("m"))
    i, j, m = F.get("ij", F.lit(0)).cast("double"), F.get("ij", F.lit(1)).cast("double"), F.col("m")
    # both ways: an unequal pair stands for two entries of m, an equal one for one entry of 2 m
    same, dif = i == j, i - j
    s = lambda e, n: F.sum(e).alias(n)
    sums = count.groupBy("row", "col", "k").agg(s(2 * m, "n"), s(2 * m * dif * dif, "c"), s(2 * m * F.abs(dif), "d"), s(F.when(same, 4 * m * m).otherwise(2 * m * m), "a"), s(F.when(same, 2 * m * F.log(2 * m)).otherwise(2 * m * F.log(m)), "e"), s(m * (i + j), "x"), s(m * (i * i + j * j), "xx"), s(2 * m * i * j, "xy"))
    n, mean = F.col("n"), F.col("x") / F.col("n")
    var = F.col("xx") / n - mean * mean
    each = sums.select("row", "col", (F.col("c") / n).alias("contrast"), (F.col("d") / n).alias("dissimilarity"), (F.col("a") / (n * n)).alias("asm"), F.greatest(F.lit(0.0), F.log(n) - F.col("e") / n).alias("entropy"), var.alias("variance"), F.when(var > 1e-9, (F.col("xy") / n - mean * mean) / var).alias("correlation"))
    names = ["contrast", "dissimilarity", "asm", "entropy", "variance", "correlation"]
    return each.join(valid.select("row", "col"), ["row", "col"], "left_semi").groupBy("row", "col").agg(*[F.avg(c).alias(c) for c in names])
