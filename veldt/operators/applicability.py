"""Where a model applies, and folds that are as far apart as its predictions are from its data."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators import ranges
from veldt.operators.nearest import nearest
from veldt.sources.shared import cut

#: Places of a block, on average, at most; BLOCKS blocks keep tasks busy, where each has LEAST places at least.
BLOCK, BLOCKS, LEAST = 1 << 17, 24, 1024
#: Rows and columns of a distance matrix that a task holds at a time.
TILE = (256, 512)
#: Clusters that are dealt to folds by the driver, at most.
MOST_CLUSTERS = 1024


def weights(importance: dict[str, float]) -> dict[str, float]:
    """Importances as weights of mean 1; negative or missing ones are 0, and without any positive one all are equal."""
    w = {k: v if v is not None and v == v and 0 < v < float("inf") else 0.0 for k, v in importance.items()}
    mean = sum(w.values()) / len(w)
    return {k: v / mean for k, v in w.items()} if mean > 0 else dict.fromkeys(w, 1.0)


def scaling(train: DataFrame, cols: list[str]) -> list[tuple[float, float]]:
    """(mean, standard deviation) a column: two numbers each reach the driver."""
    r = train.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return [(r[f"m{i}"], r[f"s{i}"]) for i in range(len(cols))]


def scaled(df: DataFrame, cols: list[str], by: list[tuple[float, float]], weight: dict[str, float]) -> DataFrame:
    """df with z0 ..: standardised and weighted; a constant column has z 0."""
    return df.withColumns({f"z{i}": (F.when(F.col(c).isNotNull(), (F.col(c) - m) / s * weight[c]) if s else F.when(F.col(c).isNotNull(), F.lit(0.0))) for i, (c, (m, s)) in enumerate(zip(cols, by, strict=True))})


def sum_of_distances(x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray) -> float:
    """The sum of the distances from each place of x to each of y, counted xn times yn; places are columns, a TILE is held at a time."""
    total, held = 0.0, np.empty((2, *TILE))
    for i in range(0, x.shape[1], TILE[0]):
        a, an = x[:, i : i + TILE[0], None], xn[i : i + TILE[0]]
        for j in range(0, y.shape[1], TILE[1]):
            b, bn = y[:, None, j : j + TILE[1]], yn[j : j + TILE[1]]
            d, gap = held[:, : len(an), : len(bn)]
            d.fill(0.0)
            for p, q in zip(a, b, strict=True):
                np.subtract(p, q, out=gap)
                np.multiply(gap, gap, out=gap)
                d += gap
            total += float(an @ (np.sqrt(d, out=d) @ bn))
    return total


def mean_distance(z: DataFrame, dims: int, key: str) -> float | None:
    """The mean distance between every two rows of z with a key; null if there are fewer than two.

    All pairs count, so that the work grows with the square of the distinct places. These are dealt to blocks of a bounded size,
    each pair of blocks is compared once in a task of its own, and only sums leave it.
    """
    zs = [f"z{i}" for i in range(dims)]
    places = cut(z.filter(F.col(key).isNotNull()).groupBy(*zs).agg(F.count(F.lit(1)).alias("n")))
    rows, rows_in_all = places.agg(F.count(F.lit(1)), F.sum("n")).first()
    if (rows_in_all or 0) < 2:
        return None
    blocks = max(-(-rows // BLOCK), min(BLOCKS, -(-rows // LEAST)))
    dealt = places.select(*zs, "n", F.pmod(F.xxhash64(*zs), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))

    def compare(pair: tuple[int, int], held: pd.DataFrame) -> pd.DataFrame:
        x, y = (held[held["own"] == b] for b in pair)
        s = sum_of_distances(*[part for p in (x, y) for part in (p[zs].to_numpy(float).T.copy(), p["n"].to_numpy(float))])
        return pd.DataFrame({"s": [s if pair[0] == pair[1] else 2 * s]})

    met = dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition(blocks * (blocks + 1) // 2, "i", "j")
    total = met.groupBy("i", "j").applyInPandas(compare, "s double").agg(F.sum("s")).first()[0]
    return total / (rows_in_all * (rows_in_all - 1))


def whisker(di: DataFrame, value: str = "di") -> float:
    """The greatest value that is not above the third quartile by over 1.5 times the quartiles' distance."""
    q = {round(r.share, 2): r.q for r in ranges.quantiles(di, value, [0.25, 0.75]).collect()}
    return di.filter(F.col(value) <= q[0.75] + 1.5 * (q[0.75] - q[0.25])).agg(F.max(value)).first()[0]


def area_of_applicability(train: DataFrame, new: DataFrame, cols: list[str], key: str, fold: str, weight: dict[str, float] | None = None) -> DataFrame:
    """new with di, threshold and inside.

    di: distance to the nearest training row in the standardised, weighted predictors, over the mean distance between
    every two training rows. threshold: the whisker of the training rows' own di, each taken from the other folds. Rows with a
    missing predictor have null di and inside. Training rows with one take no part.
    """
    weight = weight or dict.fromkeys(cols, 1.0)
    by, zs = scaling(train, cols), [f"z{i}" for i in range(len(cols))]
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])
    tz = cut(scaled(train.filter(whole), cols, by, weight).select(F.col(key).alias("__id"), F.col(fold).alias("__fold"), *zs))
    mean = mean_distance(tz, len(cols), "__id")
    own = cut(nearest(tz, tz, zs, "__id", "__fold").select((F.col("distance") / mean).alias("di")).filter("di is not null"))
    limit = whisker(own)
    found = nearest(scaled(new, cols, by, weight), tz, zs, "__id").withColumn("di", F.col("distance") / mean)
    return found.select(*new.columns, "di", F.lit(limit).alias("threshold"), (F.col("di") <= limit).alias("inside"))


def applicability_summary(aoa: DataFrame, by: list[str]) -> DataFrame:
    """by, valid_cells, inside and outside cells and percentages, di_mean, di_max; percentages of no cells are null."""
    valid, inside = F.count("di"), F.count_if(F.col("inside"))
    share = lambda n: F.when(F.col("valid_cells") > 0, 100 * n / F.col("valid_cells"))
    out = aoa.groupBy(*by).agg(valid.alias("valid_cells"), inside.alias("inside_cells"), F.avg("di").alias("di_mean"), F.max("di").alias("di_max"))
    return out.select(*by, "valid_cells", "inside_cells", (F.col("valid_cells") - F.col("inside_cells")).alias("outside_cells"), share(F.col("inside_cells")).alias("inside_percent"), share(F.col("valid_cells") - F.col("inside_cells")).alias("outside_percent"), "di_mean", "di_max")


def wasserstein(a: DataFrame, b: DataFrame, value: str = "distance") -> DataFrame:
    """One row, w: the area between two empirical distribution functions; nulls take no part."""
    one = a.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = one.union(b.select(F.col(value).alias("v"), F.lit(0), F.lit(1))).filter("v is not null")
    placed = ranges.by_ranges(both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), [], "v")
    local = Window.partitionBy(ranges.PART).orderBy(ranges.AT)
    ahead = ranges.running_sum(ranges.running_sum(placed, [], "a", "fa", "na"), [], "b", "fb", "nb")
    # the next value: in the range, or the first of a later range
    firsts = placed.groupBy(ranges.PART).agg(F.min("v").alias("first"))
    later = firsts.select(ranges.PART, F.min("first").over(Window.partitionBy(F.lit(1)).orderBy(ranges.PART).rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    step = ranges.carried(ahead, [], later).withColumn("to", F.coalesce(F.lead("v").over(local), "later"))
    gap = F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb")) * (F.col("to") - F.col("v"))
    return step.agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("w"))


def fold_statistic(train: DataFrame, new: DataFrame, cols: list[str], key: str, fold: str, task: DataFrame | None = None) -> DataFrame:
    """One row, w: how far the nearest distances between folds are from those between new places and the data.

    task: the latter distances, where they are at hand; they are the same for all folds.
    """
    return wasserstein(nearest(new, train, cols, key) if task is None else task, nearest(train, train, cols, key, fold))


def clustered_folds(train: DataFrame, cols: list[str], key: str, k: int, clusters: int) -> DataFrame:
    """train with fold: rows join the nearest of ``clusters`` centres (chosen by md5 of their key), and whole clusters, the
    largest first, the fold that has fewest rows. Only the clusters' sizes reach the driver."""
    centres = train.orderBy(F.md5(F.col(key).cast("string"))).limit(min(clusters, MOST_CLUSTERS)).withColumn("__c", F.col(key))
    placed = cut(nearest(train, centres, cols, "__c").withColumnRenamed("nn", "__c").drop("distance"))
    size = {f: 0 for f in range(k)}
    deal = []
    for r in sorted(placed.groupBy("__c").count().collect(), key=lambda r: (-r["count"], r["__c"] is None, r["__c"])):
        f = min(size, key=lambda x: (size[x], x))
        size[f] += r["count"]
        deal.append((r["__c"], f))
    folds = train.sparkSession.createDataFrame(deal, f"__c {placed.schema['__c'].dataType.simpleString()}, fold int")
    return placed.join(F.broadcast(folds), placed["__c"].eqNullSafe(folds["__c"])).select(*train.columns, "fold")


def matched_folds(train: DataFrame, new: DataFrame, cols: list[str], key: str, k: int = 5, tries: tuple[int, ...] = (8, 16, 32, 64, 128), most: float = 0.5) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(train with fold, [(clusters, w)]): the number of clusters whose folds come nearest to the prediction task.

    Tries are numbers of clusters; a deal in which one fold has more than ``most`` of the rows is left out. 0 clusters
    stands for folds dealt by hash. Missing coordinates make a cluster of their own.
    """
    n = train.count()
    task = cut(nearest(new, train, cols, key).select("distance"))
    seen, best = [], None
    hashed = F.pmod(F.xxhash64(F.col(key)), F.lit(k)).cast("int")
    for q in (0, *tries):
        folds = cut(train.withColumn("fold", hashed) if q == 0 else clustered_folds(train, cols, key, k, q))
        if q and folds.groupBy("fold").count().agg(F.max("count")).first()[0] > most * n:
            continue
        w = fold_statistic(folds, new, cols, key, "fold", task).first()[0]
        seen.append((q, w))
        if best is None or w < best[0]:
            best = (w, folds)
    return best[1], seen


def fold_faults(folds: DataFrame, key: str, k: int) -> Column:
    """Counts of what makes folds unfit, as aggregate columns by name; all are 0 for sound folds."""
    return folds.agg(F.count_if(F.col("fold").isNull()).alias("unassigned"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated"), (F.lit(k) - F.count_distinct("fold")).alias("empty"), F.count_if((F.col("fold") < 0) | (F.col("fold") >= k)).alias("unknown"))
