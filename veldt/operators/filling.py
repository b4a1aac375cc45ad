"""Missing values from a second source, calibrated where the two agree; composites that take one whole observation; codes by several names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import finite

#: The least pairs and the least share of variance for a calibration.
LEAST_PAIRS, LEAST_R2 = 30, 0.70


def calibrated_fill(rows: DataFrame, y: str, x: str, places: tuple[str, str], by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with ``filled`` and ``method``, one audit row a group) for y, filled from x where y is missing.

    In each group y is regressed on x and two places over the rows that have all four. With 30 pairs and R2 of 0.7 the missing y are
    that regression's values, held within the observed range; otherwise they are x itself. What lacks x or a place stays null.
    method is 'observed', 'calibrated', 'direct' or null. Null, NaN, infinite and the missing-value mark are missing. Groups of nulls are a
    group. The audit has n_pairs, n_missing, n_candidates, n_filled, r2, method. Sums alone leave a group; the fit is four
    numbers a group, solved in columns; collinear predictors are no calibration.
    """
    by, u = list(by), [x, *places]
    c = {k: F.when(finite(F.col(k).cast("double")), F.col(k).cast("double")) for k in (y, *u)}
    held = rows.withColumns({f"__{i}": c[k] for i, k in enumerate((y, *u))})
    usable = reduce(lambda a, b: a & b, [F.col(f"__{i}").isNotNull() for i in (1, 2, 3)])
    pair = usable & F.col("__0").isNotNull()
    v = [F.when(pair, F.col(f"__{i}")) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    fit = held.groupBy(*by).agg(F.count_if(pair).alias("n_pairs"), F.count_if(F.col("__0").isNull()).alias("n_missing"), F.count_if(F.col("__0").isNull() & usable).alias("n_candidates"), F.min(v[0]).alias("__lo"), F.max(v[0]).alias("__hi"), *[F.avg(v[i]).alias(f"__m{i}") for i in range(4)], *[F.covar_pop(v[i], v[j]).alias(f"__c{i}{j}") for i, j in pairs])
    s = lambda i, j: F.col(f"__c{min(i, j)}{max(i, j)}")
    minor = lambda i, j: (lambda a, b, p, q: s(a, p) * s(b, q) - s(a, q) * s(b, p))(*[k for k in (1, 2, 3) if k != i], *[k for k in (1, 2, 3) if k != j])
    det = sum(((-1) ** (1 + j) * s(1, j) * minor(1, j) for j in (2, 3)), s(1, 1) * minor(1, 1))
    safe = det > 1e-12 * s(1, 1) * s(2, 2) * s(3, 3)
    slope = {i: F.when(safe, sum(((-1) ** (i + j) * minor(i, j) * s(0, j) for j in (2, 3)), (-1) ** (i + 1) * minor(i, 1) * s(0, 1)) / det).alias(f"__b{i}") for i in (1, 2, 3)}
    fit = fit.select("*", *slope.values())
    r2 = F.when(s(0, 0) > 0, (F.col("__b1") * s(0, 1) + F.col("__b2") * s(0, 2) + F.col("__b3") * s(0, 3)) / s(0, 0))
    fit = fit.withColumn("r2", r2).withColumn("__ok", F.coalesce((F.col("n_pairs") >= LEAST_PAIRS) & (F.col("r2") >= LEAST_R2), F.lit(False)))
    told = reduce(lambda a, b: a + b, [F.col(f"__b{i}") * (F.col(f"__{i}") - F.col(f"__m{i}")) for i in (1, 2, 3)], F.col("__m0"))
    named = fit.select(*[F.col(b).alias(f"__g{i}") for i, b in enumerate(by)], "__ok", "__lo", "__hi", *[f"__m{i}" for i in range(4)], *[f"__b{i}" for i in (1, 2, 3)])
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__g{i}")) for i, b in enumerate(by)], F.lit(True))
    both = held.join(named if by else F.broadcast(named), on, "left")
    value = F.when(usable, F.when(F.col("__ok"), F.greatest(F.least(told, F.col("__hi")), F.col("__lo"))).otherwise(F.col("__1")))
    method = F.when(F.col("__0").isNotNull(), "observed").when(usable, F.when(F.col("__ok"), "calibrated").otherwise("direct"))
    out = both.select(*rows.columns, F.coalesce("__0", value).alias("filled"), method.alias("method"))
    audit = fit.select(*by, "n_pairs", "n_missing", "n_candidates", F.col("n_candidates").alias("n_filled"), "r2", F.when(F.col("n_candidates") == 0, "none needed").when(F.col("__ok"), "calibrated").when(F.col("n_pairs") < LEAST_PAIRS, "direct, too few pairs").otherwise("direct, low R2").alias("method"))
    return out, audit


def composite(observations: DataFrame, cell: list[str], index: str, share: float, bands: list[str], order: list[str]) -> DataFrame:
    """cell, target, bands, {band}_median and {band}_sd: the whole observation whose index stands nearest the cell's own quantile.

    share is 0.9 for leafy seasons and 0.5 for others. An observation without the index is never taken; a cell that has none has
    a target and bands of null. Gaps are compared to nine digits, and ties go to the first by ``order``. Bands come from one observation, so a null band stays null.
    sd is over the population. One shuffle by cell, which the window and the aggregation share.
    """
    whole = Window.partitionBy(*cell)
    seen = observations.withColumn("__t", F.percentile(index, share).over(whole))
    gap = F.when(F.col(index).isNotNull(), F.struct(F.round(F.abs(F.col(index) - F.col("__t")), 9).alias("gap"), *order))
    best = F.min_by(F.struct(*bands), gap).alias("__b")
    g = seen.groupBy(*cell).agg(F.first("__t").alias("target"), best, *[x for b in bands for x in (F.median(b).alias(f"{b}_median"), F.stddev_pop(b).alias(f"{b}_sd"))])
    return g.select(*cell, "target", *[F.col(f"__b.{b}").alias(b) for b in bands], *[f"{b}_{k}" for b in bands for k in ("median", "sd")])


def resolve_codes(features: DataFrame, code: str, aliases: dict[str, DataFrame]) -> DataFrame:
    """features with ``resolved``: their code or, without one, the first that their aliases give, and ``source``, which it was.

    aliases maps a column of features to a table (alias, code) of a fixed list, such as numerals or names; a list with two codes
    for an alias is an error.
    """
    out, sources = features, [(code, F.col(code).cast("int"))]
    for i, (column, lookup) in enumerate(aliases.items()):
        if lookup.groupBy("alias").agg(F.count_distinct("code").alias("n")).filter("n > 1").limit(1).count():
            raise ValueError(f"an alias of {column} has two codes")
        one = lookup.filter("alias is not null").select(F.col("alias").alias(f"__a{i}"), F.col("code").cast("int").alias(f"__k{i}")).distinct()
        out = out.join(F.broadcast(one), F.col(column) == F.col(f"__a{i}"), "left")
        sources.append((column, F.col(f"__k{i}")))
    which = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in sources])
    return out.select(*features.columns, F.coalesce(*[v for _, v in sources]).alias("resolved"), which.alias("source"))


def code_faults(resolved: DataFrame, name: str) -> DataFrame:
    """fault, n: features without a code, codes of more than one name, names of more than one code; the mapping is one to one if all are 0."""
    pairs = resolved.filter(F.col("resolved").isNotNull() & F.col(name).isNotNull()).select("resolved", name).distinct()
    twice = lambda k, o, n: pairs.groupBy(k).agg(F.count(o).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit(n).alias("fault"), "n")
    none = resolved.agg(F.count_if(F.col("resolved").isNull()).alias("n")).select(F.lit("no code").alias("fault"), "n")
    return none.union(twice("resolved", name, "code of two names")).union(twice(name, "resolved", "name of two codes"))
