"""Block partitions of a grid, and intervals of Moran's I from their sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators.blocks import weights
from veldt.operators.spatial import moran_from

SUMS = ["n", "sx", "sxx", "pairs", "xx", "xs"]
MODES = ("balanced", "partial", "drop")
#: Usable blocks, share of the cells, distance of the partition's I, spread of the blocks' cells, finite replicates.
LEAST_BLOCKS, COVERED, FAR, SPREAD, FINITE = 20, 0.95, 0.05, 0.5, 0.8


def _axis(i: Column, length: Column, size: int, offset: int, mode: str) -> tuple[Column, Column, Column]:
    """(block, first, end) of the place i on an axis; null where the mode leaves it out."""
    if mode == "balanced":
        groups = F.greatest(F.lit(1), F.floor(length / size))
        base, rest = F.floor(length / groups), length % groups
        wide = rest * (base + 1)
        b = F.when(i < wide, F.floor(i / (base + 1))).otherwise(rest + F.floor((i - wide) / base))
        first = b * base + F.least(b, rest)
        return b, first, first + base + (b < rest).cast("int")
    if mode == "partial":
        b = F.floor((i + offset) / size)
        return b, F.greatest(F.lit(0), b * size - offset), F.least(length, (b + 1) * size - offset)
    b = F.when(i >= offset, F.floor((i - offset) / size))
    first = b * size + offset
    whole = first + size <= length
    return F.when(whole, b), F.when(whole, first), F.when(whole, first + size)


def assign(cells: DataFrame, shape: DataFrame, size: tuple[int, int], offset: tuple[int, int] = (0, 0), mode: str = "balanced") -> DataFrame:
    """cells (row, col from 0) with block, r0, r1, c0, c1 (ends exclusive); cells that the mode leaves out are not there.

    shape is one row (rows, cols). ``balanced`` spreads the remainder of an axis over its blocks, which differ by one cell at
    most, and takes no offset; ``partial`` keeps fragments at the edges; ``drop`` keeps whole blocks only. Offsets count
    modulo the size. A cell's block follows from its place, so nothing is joined but the shape.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if min(size) < 1:
        raise ValueError("a block has at least one cell")
    off = tuple(o % s for o, s in zip(offset, size, strict=True))
    if mode == "balanced" and any(off):
        raise ValueError("balanced blocks take no offset")
    placed = cells.join(F.broadcast(shape.select(F.col("rows").cast("long").alias("__rows"), F.col("cols").cast("long").alias("__cols")).limit(1)))
    r, c = _axis(F.col("row"), F.col("__rows"), size[0], off[0], mode), _axis(F.col("col"), F.col("__cols"), size[1], off[1], mode)
    names = {"r0": r[1], "r1": r[2], "c0": c[1], "c1": c[2]}
    out = placed.filter(r[0].isNotNull() & c[0].isNotNull()).withColumns({"block": F.concat_ws("_", r[0].cast("long"), c[0].cast("long"))} | {k: v.cast("long") for k, v in names.items()})
    return out.drop("__rows", "__cols")


def moran_interval(blocks: DataFrame, whole: DataFrame, replicates: int, seed: int, level: float = 0.95, least: int = 0) -> DataFrame:
    """One row: the interval of Moran's I by drawing blocks, about the whole grid's I, with its diagnostics.

    blocks is (block, n, sx, sxx, pairs, xx, xs) within blocks, whole one row (n, i) of the grid. Replicates scatter about the
    partition's own I, so the basic interval is i + part - high, i + part - low, and the percentile one is moved by i - part. Columns: n_blocks,
    n_finite, i, part, mean, se, low and high of both intervals, coverage (share of the grid's cells in blocks used),
    difference (part - i), spread (of the blocks' cells). Bounds are null if fewer than 80 % of the replicates
    are finite. Blocks with fewer than ``least`` cells are not used.
    """
    used = blocks.filter(F.col("n") >= least)
    total = used.agg(F.count("block").alias("n_blocks"), *[F.sum(c).alias(c) for c in SUMS], (F.stddev_samp("n") / F.avg("n")).alias("spread"))
    own = total.select("n_blocks", "spread", F.col("n").alias("held"), moran_from(*[F.col(c) for c in SUMS]).alias("part"))
    drawn = used.join(weights(used.select("block"), [], replicates, seed), "block").groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in SUMS])
    each = drawn.select(moran_from(*[F.col(c) for c in SUMS]).alias("ip")).filter(F.col("ip").isNotNull() & ~F.isnan("ip"))
    a = (1 - level) / 2
    seen = each.agg(F.count("ip").alias("n_finite"), F.avg("ip").alias("mean"), F.stddev_samp("ip").alias("se"), F.percentile("ip", a).alias("q_low"), F.percentile("ip", 1 - a).alias("q_high"))
    one = own.join(F.broadcast(seen)).join(F.broadcast(whole.select(F.col("n").alias("cells"), "i")))
    enough = F.col("n_finite") >= max(2, -(-int(replicates * FINITE * 1000) // 1000))
    i, part, lo, hi = (F.col(c) for c in ("i", "part", "q_low", "q_high"))
    bound = lambda e, n: F.when(enough, e).alias(n)
    return one.select("n_blocks", "n_finite", "i", "part", "mean", "se", bound(i + part - hi, "basic_low"), bound(i + part - lo, "basic_high"), bound(i + lo - part, "percentile_low"), bound(i + hi - part, "percentile_high"), (F.col("held") / F.col("cells")).alias("coverage"), (part - i).alias("difference"), "spread")


def reasons(mode: str) -> Column:
    """Why an interval of moran_interval is not to be relied on, comma-joined; empty if it is."""
    found = [F.when(F.col("n_blocks") < LEAST_BLOCKS, f"fewer_than_{LEAST_BLOCKS}_blocks"), F.when(F.col("coverage") < COVERED, "coverage_below_95pct"), F.when(F.abs("difference") > FAR, "partition_difference_too_large"), F.when(F.col("spread") > SPREAD, "valid_pixels_per_block_cv_too_large"), F.when(F.lit(mode == "partial"), "partial_edge_blocks_equal_weight")]
    return F.concat_ws(",", *found)
