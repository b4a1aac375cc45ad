"""What forecasts say when one predictor is set: profiles over a grid, differences from a reference, hold-outs beyond a limit; fair ranks of settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators import ranges

#: The least reference value that a percentage is taken of, rows held out, rows to learn from.
LEAST_REFERENCE, LEAST_HELD, LEAST_TRAIN = 1e-6, 20, 100


def over_grid(rows: DataFrame, name: str, values: list[float]) -> DataFrame:
    """rows once for each value of the predictor ``name``, which replaces the rows' own; no join."""
    return rows.drop(name).select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))


def profile(forecasts: DataFrame, name: str, layers: list[str]) -> DataFrame:
    """name, layer, n, mean, median, q05, q95, least, greatest of each forecast layer at each value of the grid.

    Null forecasts take no part; a layer without any has no row. Quantiles are exact and come from ranges.
    """
    long = forecasts.select(name, *layers).unpivot([name], layers, "layer", "v").filter("v is not null")
    plain = long.groupBy(name, "layer").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    q = ranges.quantiles(long, "v", [0.05, 0.5, 0.95], [name, "layer"])
    at = lambda s, n: F.max(F.when(F.col("share") == s, F.col("q"))).alias(n)
    return plain.join(q.groupBy(name, "layer").agg(at(0.5, "median"), at(0.05, "q05"), at(0.95, "q95")), [name, "layer"])


def against_reference(forecasts: DataFrame, key: list[str], name: str, reference: float, layers: list[str]) -> DataFrame:
    """key, name, and {layer}_change and {layer}_percent of each layer against the row's own forecast at the reference value.

    Rows at the reference are not returned. A percentage of a reference within 1e-6 of zero is null, and so is what lacks a
    side. One shuffle by key; the reference is the side that is filtered, not broadcast.
    """
    ref = forecasts.filter(F.col(name) == reference).select(*key, *[F.col(c).alias(f"__{c}") for c in layers])
    both = forecasts.filter(F.col(name) != reference).join(ref, key, "left")
    change = lambda c: F.col(c) - F.col(f"__{c}")
    return both.select(*key, name, *[x for c in layers for x in (change(c).alias(f"{c}_change"), F.when(F.abs(f"__{c}") > LEAST_REFERENCE, 100 * change(c) / F.col(f"__{c}")).alias(f"{c}_percent"))])


def limits(rows: DataFrame, name: str, thresholds: list[float]) -> DataFrame:
    """threshold, n_held, n_train, train_max, status: what a hold-out of all rows at or above each threshold would be."""
    c = F.col(name)
    one = rows.filter(c.isNotNull()).agg(*[x for i, t in enumerate(thresholds) for x in (F.count_if(c >= t).alias(f"h{i}"), F.count_if(c < t).alias(f"t{i}"), F.max(F.when(c < t, c)).alias(f"m{i}"))])
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"h{i}").alias("n_held"), F.col(f"t{i}").alias("n_train"), F.col(f"m{i}").cast("double").alias("train_max")) for i, t in enumerate(thresholds)])
    enough = (F.col("n_held") >= LEAST_HELD) & (F.col("n_train") >= LEAST_TRAIN)
    return one.select(F.inline(each)).withColumn("status", F.when(enough, "ok").otherwise("too few"))


def held_out(rows: DataFrame, name: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of all hold-outs whose status is ok, each with threshold; test has every held row in two modes.

    ``clamped`` sets the predictor to the largest that was learned from, ``uncapped`` leaves it. found is limits(...), a row a threshold.
    """
    ok = F.broadcast(found.filter("status = 'ok'").select("threshold", "train_max"))
    train = rows.join(ok, F.col(name) < F.col("threshold")).drop("train_max")
    test = rows.join(ok, F.col(name) >= F.col("threshold")).select("*", F.explode(F.array(F.lit("clamped"), F.lit("uncapped"))).alias("mode"))
    set_ = F.when(F.col("mode") == "clamped", F.least(F.col(name), F.col("train_max"))).otherwise(F.col(name))
    return train, test.withColumn(name, set_).drop("train_max")


def coverage(forecasts: DataFrame, by: list[str], y: str, layers: dict[str, float]) -> DataFrame:
    """by, quantile, n, coverage, gap, pinball, bias, above: how often y lies at or below each forecast quantile, and the rest; above in percent."""
    each = F.array(*[F.struct(F.lit(s).alias("quantile"), F.col(c).alias("q")) for c, s in layers.items()])
    long = forecasts.select(*by, y, F.inline(each)).filter(F.col("q").isNotNull() & F.col(y).isNotNull())
    e, s = F.col(y) - F.col("q"), F.col("quantile")
    return long.groupBy(*by, "quantile").agg(F.count("q").alias("n"), F.avg((e <= 0).cast("int")).alias("coverage"), (F.avg((e <= 0).cast("int")) - F.first("quantile")).alias("gap"), F.avg(F.when(e >= 0, s * e).otherwise((s - 1) * e)).alias("pinball"), F.avg(-e).alias("bias"), (100 * F.avg((e > 0).cast("int"))).alias("above"))


def verdict(largest: Column, covered: Column, above: Column) -> Column:
    """What coverage of the 95 % quantile by clamped forecasts means, at the strictest threshold."""
    return F.when(largest < 120, "not reached").when((covered < 0.85) & (above > 10), "unreliable, a lower bound").when(covered < 0.90, "within the area of applicability only").otherwise("credible")


def fair_ranking(ranked: DataFrame, response: str, setting: str, score: str) -> DataFrame:
    """setting, score (mean over responses), n_responses, complete, place: only settings tried for all responses are compared.

    If none was, all are. Null scores count as not tried; ties go to the smaller setting. A setting out of the comparison has
    no place. Settings are few.
    """
    tried = ranked.filter(F.col(score).isNotNull())
    every = tried.agg(F.count_distinct(response).alias("__all"))
    g = tried.groupBy(setting).agg(F.avg(score).alias("score"), F.count_distinct(response).alias("n_responses")).join(F.broadcast(every))
    g = g.withColumn("complete", F.col("n_responses") == F.col("__all"))
    all_ = Window.partitionBy(F.lit(1))  # a row a setting
    open_ = F.col("complete") | ~F.max("complete").over(all_)
    return g.withColumn("__open", open_).withColumn("place", F.when(F.col("__open"), F.row_number().over(Window.partitionBy("__open").orderBy("score", setting)))).drop("__all", "__open")


def rho_gate(primary: DataFrame, stress: DataFrame, robust: float = 0.5, collapse: float = 0.1, clear: float = 10.0, shift: float = 1.0) -> DataFrame:
    """response, retention, floor_ratio, year_shift, their classes, row_gate, overall, severity.

    Both sides have a row a response: rho, breaks, modal_year; stress also least_p, and cutoff, the p up to which
    its false-discovery control rejects. A response that one side lacks, or twice, is an error. Values that make a
    row invalid (no rho, no or negative counts) are NO_GO for all.
    """
    p = primary.select("response", *[F.col(c).alias(f"p_{c}") for c in ("rho", "breaks", "modal_year")])
    s = stress.select("response", *[F.col(c).alias(f"s_{c}") for c in ("rho", "breaks", "modal_year", "least_p", "cutoff")])
    faults = primary.select("response", F.lit(1).alias("p"), F.lit(0).alias("s")).union(stress.select("response", F.lit(0), F.lit(1))).groupBy("response").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).filter("p <> 1 or s <> 1")
    if faults.limit(1).count():
        raise ValueError("primary and stress must have one row for each response")
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    x = p.join(s, "response")
    retention = F.when(real("p_breaks") & (F.col("p_breaks") > 0), F.col("s_breaks") / F.col("p_breaks"))
    floor = F.when(real("s_cutoff") & real("s_least_p") & (F.col("s_least_p") > 0), F.col("s_cutoff") / F.col("s_least_p"))
    x = x.withColumns({"retention": retention, "floor_ratio": floor, "year_shift": F.col("s_modal_year") - F.col("p_modal_year")})
    invalid = ~reduce(lambda a, b: a & b, [real(c) for c in ("p_rho", "s_rho", "p_breaks", "s_breaks")]) | (F.col("p_breaks") < 0) | (F.col("s_breaks") < 0)
    x = x.withColumn("bad", F.coalesce(invalid, F.lit(True)))
    r = F.col("retention")
    kept = F.when(F.col("bad"), "NOT_EVALUABLE").when(F.col("p_breaks") == 0, "PRIMARY_ZERO_RECOVERY").when(r >= robust, "ROBUST").when(r >= collapse, "SENSITIVE").otherwise("COLLAPSE")
    x = x.withColumns({"retention_class": kept, "floor_class": F.when(F.col("floor_ratio").isNull(), "NO_FDR_CUTOFF").when(F.col("floor_ratio") >= clear, "CLEAR_OF_MC_FLOOR").otherwise("NEAR_MC_FLOOR"), "year_class": F.when(F.col("year_shift").isNull(), "NOT_EVALUABLE").when(F.abs("year_shift") <= shift, "MODAL_YEAR_STABLE").otherwise("MODAL_YEAR_SHIFT")})
    good = F.col("retention_class").isin("ROBUST", "PRIMARY_ZERO_RECOVERY")
    x = x.withColumn("row_gate", F.when(F.col("bad"), "NO_GO").when(good, "GO").otherwise("CONDITIONAL_GO"))
    has = lambda c: F.bool_or(F.col("retention_class") == c)
    whole = x.agg(F.when(F.bool_or("bad"), "NO_GO").when(F.bool_and(good), "GO").otherwise("CONDITIONAL_GO").alias("overall"), F.when(F.bool_or("bad"), "GATE_INTEGRITY_FAILURE").when(has("COLLAPSE"), "SEVERE_RHO_MODEL_SENSITIVITY").when(has("SENSITIVE"), "MATERIAL_RHO_MODEL_SENSITIVITY").otherwise("RHO_STRESS_ROBUST").alias("severity"))
    return x.join(F.broadcast(whole)).select("response", "retention", "floor_ratio", "year_shift", "retention_class", "floor_class", "year_class", "row_gate", "overall", "severity")


def acceptance(cells: DataFrame, raster: DataFrame, summary: DataFrame, codes: dict[str, int], zones: list[str], tolerance: float = 1e-7) -> DataFrame:
    """fault, n, status: where a published summary and raster do not say what the cell table says; PASS where n is 0.

    cells (cell, zone, class6, area), raster (cell, code), summary (zone, class6, n, area), whose zones are those given and
    Overall. A class outside codes is no class. Every zone needs each class once.
    """
    code = F.coalesce(*[F.when(F.col("class6") == k, v) for k, v in codes.items()])
    met = cells.withColumn("want", code).join(raster.select("cell", "code", F.lit(1).alias("there")), "cell", "full")
    in_table, off = F.col("want").eqNullSafe(F.col("code")), F.col("there").isNull()
    side = met.agg(F.count_if(F.col("code").isNotNull() & ~F.col("code").isin(list(codes.values()))).alias("unknown code"), F.count_if(off).alias("cell outside the raster"), F.count_if(~off & F.col("area").isNotNull() & ~in_table).alias("class and code differ"))
    dim = cells.sparkSession.createDataFrame([(z, k) for z in [*zones, "Overall"] for k in codes], "zone string, class6 string")
    count = cells.filter(code.isNotNull()).groupingSets([["zone", "class6"], ["class6"]], "zone", "class6").agg(F.count(F.lit(1)).alias("k"), F.sum("area").alias("a"), F.grouping("zone").alias("g"))
    count = count.select(F.when(F.col("g") == 1, "Overall").otherwise(F.col("zone")).alias("zone"), "class6", "k", "a")
    rows = summary.groupBy("zone", "class6").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), F.max("area").alias("area"))
    full = dim.join(rows, ["zone", "class6"], "left").join(count, ["zone", "class6"], "left").na.fill(0, ["k"]).na.fill(0.0, ["a"])
    differs = (F.col("n") != F.col("k")) | (F.abs(F.col("area") - F.col("a")) > tolerance) | F.col("n").isNull() | F.col("area").isNull()
    other = full.agg(F.count_if(~F.col("times").eqNullSafe(1)).alias("summary row missing or repeated"), F.count_if((F.col("times") == 1) & differs).alias("summary and cells differ"))
    out = side.unpivot([], side.columns, "fault", "n").union(other.unpivot([], other.columns, "fault", "n"))
    return out.withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))
