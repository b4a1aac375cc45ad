"""Neighbours on a grid: Moran's I, Gi*, focal statistics, patches.

Neighbours meet by an equi-join on shifted coordinates, so a kernel of k offsets costs k rows a cell; square
windows of any size are separable and take two range windows instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.sources.shared import stored

#: (dr, dc) of the kernels.
ROOK = ((-1, 0), (1, 0), (0, -1), (0, 1))
QUEEN = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))


def circle(radius: int) -> tuple[tuple[int, int], ...]:
    span = range(-radius, radius + 1)
    return tuple((r, c) for r in span for c in span if 0 < r * r + c * c <= radius * radius)


def neighbours(grid: DataFrame, kernel=QUEEN, keep: list[str] = ()) -> DataFrame:
    """row, col, v, nv for every ordered pair of valid neighbours; ``keep`` columns must agree on both sides."""
    valid = grid.filter("v is not null")
    offsets = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in kernel])
    sent = valid.select("row", "col", *keep, F.col("v").alias("nv"), F.explode(offsets).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), *keep, "nv")
    return valid.join(sent, ["row", "col", *keep])


def moran_sums(grid: DataFrame, kernel=QUEEN, by: list[str] = ()) -> DataFrame:
    """n, sx, sxx, w, xx, xs by group: all that Moran's I needs, additive over groups of blocks."""
    cells = grid.filter("v is not null").groupBy(*by).agg(F.count("v").alias("n"), F.sum("v").alias("sx"), F.sum(F.col("v") * F.col("v")).alias("sxx"))
    pairs = neighbours(grid, kernel, list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("w"), F.sum(F.col("v") * F.col("nv")).alias("xx"), F.sum(F.col("v") + F.col("nv")).alias("xs"))
    if by:
        return cells.join(pairs, list(by), "left").na.fill(0, ["w"]).na.fill(0.0, ["xx", "xs"])
    return cells.join(F.broadcast(pairs))


def moran_from(n: Column, sx: Column, sxx: Column, w: Column, xx: Column, xs: Column) -> Column:
    mean = sx / n
    return F.when((n >= 2) & (w > 0), n / w * (xx - mean * xs + mean * mean * w) / (sxx - n * mean * mean))


def gi_star(grid: DataFrame, kernel=QUEEN) -> DataFrame:
    """row, col, z: the local statistic with the cell itself in its window; global moments travel as one row."""
    every = neighbours(grid, (*kernel, (0, 0))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("w"), F.sum("nv").alias("s"))
    moments = grid.filter("v is not null").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    x = every.join(F.broadcast(moments))
    under = F.col("sd") * F.sqrt((F.col("w") * (F.col("n") - F.col("w"))) / (F.col("n") - 1))
    return x.select("row", "col", F.when(under > 0, (F.col("s") - F.col("mean") * F.col("w")) / under).alias("z"))


def focal_square(grid: DataFrame, radius: int) -> DataFrame:
    """row, col, n, mean, sd over the square window of the radius: sums along columns, then along rows."""
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    one = grid.select("row", "col", F.count("v").over(across).alias("n"), F.sum("v").over(across).alias("s"), F.sum(F.col("v") * F.col("v")).over(across).alias("q"))
    two = one.select("row", "col", F.sum("n").over(down).alias("n"), F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q"))
    mean = F.col("s") / F.col("n")
    return two.filter("n > 0").select("row", "col", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("sd"))


def patches(mask: DataFrame, rounds: int = 64) -> DataFrame:
    """row, col, patch: 8-connected components of the cells given, each named by its least (row, col).

    Labels fall to the least of the neighbourhood and then jump to their label's label, which halves what is
    left; each round is stored in the shared folder, and the loop ends when no label changes. Cells are sorted and merged:
    their files are far smaller than the cells, and would be broadcast for it.
    """
    cells = mask.select("row", "col", F.struct("row", "col").alias("v"))
    now = stored(cells)
    for _ in range(rounds):
        low = neighbours(now.hint("merge"), QUEEN).groupBy("row", "col").agg(F.min("nv").alias("m"))
        met = now.join(low, ["row", "col"], "left").select("row", "col", "v", F.least("v", F.coalesce("m", "v")).alias("u"))
        jump = met.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("u").alias("w"))
        after = stored(met.join(jump.hint("merge"), (F.col("u.row") == F.col("r")) & (F.col("u.col") == F.col("c"))).select("row", "col", F.col("v").alias("old"), F.least("u", "w").alias("v")))
        changed = after.filter("old <> v").limit(1).count()
        now = after.select("row", "col", "v")
        if not changed:
            return now.select("row", "col", F.concat_ws("_", "v.row", "v.col").alias("patch"))
    raise RuntimeError("patches did not settle")
