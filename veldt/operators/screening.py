"""Feature screening on all rows: rank correlations from distributed ranks, one scale a family, stepwise variance inflation.

Only p x p sums reach the driver, p being the number of features.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators import ranges
from veldt.sources.shared import cut

#: Fixed value: a scale token of a feature's name (a window or a distance), which is not part of its family's name.
SCALE = r"_(w[0-9]+|[0-9]+m|[0-9]+km)(?=_|$)"
MOST_VIF = 10.0


def family(name: str) -> str:
    return re.sub(SCALE, "", name)


def average_ranks(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key and the average rank of each column; a null, which has no rank, stays null.

    All columns are ranked in one pass over ranges of (column, value); ties share the mean of their ranks.
    """
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(key, cols, "__c", "__x").filter("__x is not null")
    levels = long.groupBy("__c", "__x").agg(F.count(F.lit(1)).alias("__k"))
    ranked = ranges.running_sum(ranges.by_ranges(levels, ["__c"], "__x"), ["__c"], "__k", "__r", "__n")
    ranked = ranked.select("__c", "__x", (F.col("__r") - (F.col("__k") - 1) / 2).alias("rank"))
    wide = long.join(ranked, ["__c", "__x"]).groupBy(key).pivot("__c", cols).agg(F.first("rank"))
    return df.select(key).join(wide, key, "left")


def correlations(df: DataFrame, cols: list[str]) -> np.ndarray:
    """The matrix of correlations of the columns: one aggregation of sums of pairs."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    out = np.eye(len(cols))
    for i, j in pairs:
        out[i, j] = out[j, i] = np.nan if r[f"r{i}_{j}"] is None else r[f"r{i}_{j}"]
    return out


def spearman(df: DataFrame, cols: list[str], y: str) -> dict[str, float]:
    """|rank correlation| with y by column; 0 for a column without variance.

    Rows are counted by column, value and response, and ranks meet these counts: no row is kept or shuffled on its own.
    """
    if not cols:
        return {}
    long = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("__y", cols, "__c", "__x")
    held = cut(long.groupBy("__c", "__x", "__y").agg(F.count(F.lit(1)).alias("__w")))
    every = held.filter(F.col("__c") == cols[0]).select(F.lit(None).cast("string").alias("__c"), F.col("__y").alias("__x"), "__w")  # the response, a column of no name
    levels = held.select("__c", "__x", "__w").union(every).filter("__x is not null").groupBy("__c", "__x").agg(F.sum("__w").alias("__k"))
    ranked = ranges.running_sum(ranges.by_ranges(levels, ["__c"], "__x"), ["__c"], "__k", "__r", "__n")
    off = F.col("__r") - (F.col("__k") - 1) / 2 - (F.col("__n") + 1) / 2  # average rank, less the mean of all ranks
    a = ranked.filter("__c is not null").select("__c", "__x", off.alias("a"))
    b = ranked.filter("__c is null").select(F.col("__x").alias("__y"), off.alias("b"))
    both = held.join(a, ["__c", "__x"]).join(b, "__y")
    w, x, z = F.col("__w"), F.col("a"), F.col("b")
    sums = both.groupBy("__c").agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * z).alias("y"), F.sum(w * x * z).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * z * z).alias("yy"), (F.min("a") < F.max("a")).alias("u"), (F.min("b") < F.max("b")).alias("v"))
    out = dict.fromkeys(cols, 0.0)
    for r in sums.collect():  # a row a column
        under = (r.xx - r.x * r.x / r.n) * (r.yy - r.y * r.y / r.n)
        if r.u and r.v and under > 0:
            out[r["__c"]] = abs(r.xy - r.x * r.y / r.n) / float(np.sqrt(under))
    return out


def best_scales(rho: dict[str, float]) -> list[str]:
    """Of each family the feature of the largest correlation, names breaking ties; in the order of rho."""
    best: dict[str, str] = {}
    for name in sorted(rho, key=lambda c: (-rho[c], c)):
        best.setdefault(family(name), name)
    return [c for c in rho if best[family(c)] == c]


def inflation(r: np.ndarray) -> np.ndarray:
    """Variance inflation of each feature from their correlations; infinite where the others determine it."""
    out = np.full(len(r), np.inf)
    for j in range(len(r)):
        rest = [i for i in range(len(r)) if i != j]
        if not rest:
            out[j] = 1.0
            continue
        share = r[j, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)]) @ r[rest, j]
        if 1 - share > np.finfo(float).eps:
            out[j] = 1 / (1 - share)
    return out


def screen(df: DataFrame, key: str, cols: list[str], y: str, most: float = MOST_VIF) -> DataFrame:
    """feature, family, rho, scale_kept, vif, kept: a row a feature that varies. Rows need no key of their own.

    Of a family the scale of the largest rank correlation stays; then the feature of the largest inflation goes, the
    first on ties, until none is above ``most``. vif is that at the step where a feature went, or at the end.
    """
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    cols = [c for c in cols if spread[c] and np.isfinite(spread[c])]
    rho = spearman(df, cols, y)
    names = best_scales(rho)
    r = correlations(df, names)
    now, vif = list(range(len(names))), {}
    while now:
        v = inflation(r[np.ix_(now, now)])
        top = int(v.argmax())
        vif |= {names[i]: float(x) for i, x in zip(now, v, strict=True)}
        if len(now) == 1 or v[top] <= most:
            break
        now.pop(top)
    kept = {names[i] for i in now}
    rows = [(c, family(c), rho[c], c in names, vif.get(c), c in kept) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, family string, rho double, scale_kept boolean, vif double, kept boolean")


def allocate(counts: dict, total: int, least: int) -> dict:
    """How many of ``total`` each stratum gives: one each, then up to ``least`` from the smallest on, the rest by what is left of each.

    Shares of the rest are rounded down, round after round; what rounding leaves goes one each to the strata with
    most left. No stratum gives more than it has; too small a total goes to the largest strata.
    """
    have = {k: n for k, n in counts.items() if n > 0}
    total = min(total, sum(have.values()))
    give = dict.fromkeys(counts, 0)
    for k in sorted(have, key=lambda k: (-have[k], str(k)))[:total]:
        give[k] = 1
    left = total - sum(give.values())
    for k in sorted(have, key=lambda k: (have[k], str(k))):
        more = max(0, min(left, have[k] - give[k], least - give[k]))
        give[k], left = give[k] + more, left - more
    while left > 0:
        room = {k: have[k] - give[k] for k in have}
        share = {k: left * room[k] // sum(room.values()) for k in have}
        if not any(share.values()):
            for k in sorted((k for k in have if room[k]), key=lambda k: (-room[k], str(k)))[:left]:
                share[k] = 1
        for k, n in share.items():
            give[k] += n
        left = total - sum(give.values())
    return give


def draw_strata(df: DataFrame, stratum: str, key: str, give: DataFrame, seed: str) -> DataFrame:
    """The rows of df that come first, by md5 of seed and key, in their stratum; give (stratum, take) says how many.

    Ranks are carried over ranges, so a stratum of any size is never one task; which rows are drawn does not depend on
    partitions. Strata without a row in give yield none.
    """
    keyed = df.withColumns({"__key": F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), "__one": F.lit(1)})
    ranked = ranges.running_sum(ranges.by_ranges(keyed, [stratum], "__key"), [stratum], "__one", "__k", "__n")
    named = give.select(F.col(stratum).alias("__s"), "take")
    return ranked.join(F.broadcast(named), F.col(stratum).eqNullSafe(F.col("__s"))).filter(F.col("__k") <= F.col("take")).select(*df.columns)


def environment_strata(df: DataFrame, key: str, cols: list[str], axes: int, strata: int, seed: int = 1) -> DataFrame:
    """key, stratum: k-means of the leading principal components of standardised columns; rows with a missing value are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=cols, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="__z", withMean=True), PCA(k=min(axes, len(cols)), inputCol="__z", outputCol="__pc"), KMeans(k=strata, seed=seed, featuresCol="__pc", predictionCol="stratum")]
    return Pipeline(stages=steps).fit(df).transform(df).select(key, "stratum")


def stratified_points(df: DataFrame, key: str, cols: list[str], total: int, axes: int = 4, strata: int = 50, least: int = 200, seed: str = "points") -> DataFrame:
    """key, stratum of ``total`` rows spread over environments: strata by environment_strata, shares by allocate, rows by draw_strata."""
    placed = cut(environment_strata(df, key, cols, axes, strata))
    counts = {r.stratum: r["count"] for r in placed.groupBy("stratum").count().collect()}  # a row a stratum
    give = df.sparkSession.createDataFrame(sorted(allocate(counts, total, least).items()), "stratum int, take long")
    return draw_strata(placed, "stratum", key, give, seed)
