"""Polygons over a grid of cells: points to polygons, and areas of unions.

A polygon is its edges (poly, x0, y0, x1, y1); inside is where a ray crosses an odd number of them, so rings and holes
need no order. Cells that no edge enters are wholly inside or outside, and a point there is settled by an equi-join on
the cell. Only points in border cells are tested, against the edges that share the cell's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell is entered by an edge that comes this near to it, in cells: rounding must not hide a crossing.
NEAR = 1e-9


def edges_of(rings: DataFrame, poly: str, ring: list[str], order: str, x: str, y: str) -> DataFrame:
    """poly, x0, y0, x1, y1: the closed edges of rings given by their corners in order."""
    w = Window.partitionBy(poly, *ring).orderBy(order)
    first = Window.partitionBy(poly, *ring).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(w), F.first(c).over(first)).alias(n) for c, n in ((x, "x1"), (y, "y1"))]
    return rings.select(F.col(poly).alias("poly"), F.col(x).alias("x0"), F.col(y).alias("y0"), *nxt)


def at_height(y: Column) -> Column:
    """Where an edge is at height y."""
    return F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))


def bands(edges: DataFrame, size: float) -> DataFrame:
    """row and the edges that touch this row of cells."""
    low, high = F.least("y0", "y1") / size - NEAR, F.greatest("y0", "y1") / size + NEAR
    return edges.select("*", F.explode(F.sequence(F.floor(low), F.floor(high))).alias("row"))


def border_cells(banded: DataFrame, size: float) -> DataFrame:
    """poly, row, col of all cells that an edge enters."""
    bottom, top = F.col("row") * size, (F.col("row") + 1) * size
    flat = F.col("y0") == F.col("y1")
    clip = lambda y: at_height(F.greatest(F.least("y0", "y1"), F.least(F.greatest("y0", "y1"), y)))
    a, b = F.when(flat, F.col("x0")).otherwise(clip(bottom)), F.when(flat, F.col("x1")).otherwise(clip(top))
    cols = F.sequence(F.floor(F.least(a, b) / size - NEAR), F.floor(F.greatest(a, b) / size + NEAR))
    return banded.select("poly", "row", F.explode(cols).alias("col")).distinct()


def inner_cells(banded: DataFrame, borders: DataFrame, size: float) -> DataFrame:
    """poly, row, col of cells inside that no edge enters: those between the crossings of a row's middle line."""
    mid = (F.col("row") + 0.5) * size
    crossing = banded.filter((F.col("y0") > mid) != (F.col("y1") > mid)).select("poly", "row", at_height(mid).alias("x"))
    w = Window.partitionBy("poly", "row").orderBy("x")
    runs = crossing.select("poly", "row", "x", F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("k")).filter("k % 2 = 1")
    first, last = F.ceil(F.col("x") / size - 0.5), F.floor(F.col("to") / size - 0.5)
    cells = runs.filter(first <= last).select("poly", "row", F.explode(F.sequence(first, last)).alias("col"))
    return cells.join(borders, ["poly", "row", "col"], "left_anti")


def cover(edges: DataFrame, size: float) -> DataFrame:
    """poly, row, col, edges: all cells of the polygons; edges is null inside, and has the row's edges at the border."""
    banded = bands(edges, size)
    borders = border_cells(banded, size)
    row_edges = banded.groupBy("poly", "row").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    inner = inner_cells(banded, borders, size).select("poly", "row", "col", F.lit(None).cast(row_edges.schema["edges"].dataType).alias("edges"))
    return borders.join(row_edges, ["poly", "row"]).select("poly", "row", "col", "edges").union(inner)


def within(points: DataFrame, edges: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """points with poly, one row for each polygon that holds the point; points in none, or without a place, have no row.

    A point on an edge is inside if the edge is on its right (half-open, as for any crossing count), so polygons
    that share an edge never both hold it.
    """
    cells = cover(edges, size)
    placed = points.withColumns({"__row": F.floor(F.col(y) / size), "__col": F.floor(F.col(x) / size)})
    met = placed.join(cells, (F.col("__row") == F.col("row")) & (F.col("__col") == F.col("col")))

    def crossed(e: Column) -> Column:
        cut = e["x0"] + (F.col(y) - e["y0"]) / (e["y1"] - e["y0"]) * (e["x1"] - e["x0"])
        return ((e["y0"] > F.col(y)) != (e["y1"] > F.col(y))) & (F.col(x) < cut)

    inside = F.col("edges").isNull() | (F.size(F.filter("edges", crossed)) % 2 == 1)
    return met.filter(inside).select(*points.columns, "poly")


def crossings(banded: DataFrame, size: float) -> DataFrame:
    """row, y of every place where two edges cross; edges meet by the cells that both enter."""
    named = banded.withColumn("e", F.xxhash64("poly", "x0", "y0", "x1", "y1"))
    bottom, top = F.col("row") * size, (F.col("row") + 1) * size
    flat = F.col("y0") == F.col("y1")
    clip = lambda y: at_height(F.greatest(F.least("y0", "y1"), F.least(F.greatest("y0", "y1"), y)))
    a, b = F.when(flat, F.col("x0")).otherwise(clip(bottom)), F.when(flat, F.col("x1")).otherwise(clip(top))
    cols = F.sequence(F.floor(F.least(a, b) / size - NEAR), F.floor(F.greatest(a, b) / size + NEAR))
    cells = named.select("row", F.explode(cols).alias("col"), F.struct("e", "x0", "y0", "x1", "y1").alias("s"))
    p, q = F.col("p.s"), F.col("q.s")
    pairs = cells.alias("p").join(cells.alias("q"), (F.col("p.row") == F.col("q.row")) & (F.col("p.col") == F.col("q.col")) & (p["e"] < q["e"]))
    dx, dy, ex, ey = p["x1"] - p["x0"], p["y1"] - p["y0"], q["x1"] - q["x0"], q["y1"] - q["y0"]
    det = dx * ey - dy * ex
    t = F.when(det != 0, ((q["x0"] - p["x0"]) * ey - (q["y0"] - p["y0"]) * ex) / det)
    u = F.when(det != 0, ((q["x0"] - p["x0"]) * dy - (q["y0"] - p["y0"]) * dx) / det)
    met = pairs.filter((t > 0) & (t < 1) & (u > 0) & (u < 1))
    return met.select(F.col("p.row").alias("row"), (p["y0"] + t * dy).alias("y"))


def union_area(edges: DataFrame, size: float) -> DataFrame:
    """One row: area_sum (polygons one by one), area_union, area_shared (in two polygons or more).

    Each row of cells is cut into slabs at all corners and crossings in it; within a slab no edges cross, so widths at
    its middle times its height are exact. Widths come from one run over the crossings of the middle line: a polygon's odd
    crossing opens it, its even one closes it. Slabs of different rows never meet in a task.
    """
    banded = bands(edges, size)
    bottom, top = F.col("row") * size, (F.col("row") + 1) * size
    corners = banded.select("row", F.explode(F.array(F.col("y0"), F.col("y1"), bottom, top)).alias("y"))
    ys = corners.union(crossings(banded, size)).filter((F.col("y") >= bottom) & (F.col("y") <= top)).distinct()
    slabs = ys.select("row", "y", F.lead("y").over(Window.partitionBy("row").orderBy("y")).alias("to")).filter("to > y")
    slabs = slabs.select(F.col("row").alias("r"), "y", (F.col("to") - F.col("y")).alias("h"), ((F.col("y") + F.col("to")) / 2).alias("m"))
    cut = slabs.join(banded, (F.col("r") == F.col("row")) & ((F.col("y0") > F.col("m")) != (F.col("y1") > F.col("m"))))
    cut = cut.select("r", "y", "h", "poly", at_height(F.col("m")).alias("x"))
    turn = F.when(F.row_number().over(Window.partitionBy("r", "y", "poly").orderBy("x")) % 2 == 1, 1).otherwise(-1)
    line = Window.partitionBy("r", "y").orderBy("x", F.desc("d"))
    deep = cut.withColumn("d", turn).select("h", (F.lead("x").over(line) - F.col("x")).alias("w"), F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    width = F.col("w") * F.col("h")
    zero = F.lit(0.0)
    return deep.agg(F.coalesce(F.sum(width * F.col("n")), zero).alias("area_sum"), F.coalesce(F.sum(F.when(F.col("n") > 0, width)), zero).alias("area_union"), F.coalesce(F.sum(F.when(F.col("n") > 1, width)), zero).alias("area_shared"))
