"""Nested validation by sufficient statistics: every fold's fit is a difference of sums, so no fold reads the rows again.

The model is a group mean shrunk towards the whole mean by ``lam`` rows. Outer folds hold out rows for the result, inner
folds choose lam; both come from one aggregation by (outer, inner, group), whatever the number of folds or candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import draw


def latin_hypercube(spark: SparkSession, n: int, dims: int, seed: str) -> DataFrame:
    """candidate 1..n, u1 .. : one value a stratum of [0, 1) in each dimension, by keyed ranks; for candidates, so n is small."""
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("candidate"))
    for j in range(1, dims + 1):
        key = draw(seed, F.lit(str(j)), F.col("candidate").cast("string"))
        inside = draw(f"{seed}u", F.lit(str(j)), F.col("candidate").cast("string")) / 4294967296.0
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key, "candidate"))
        rows = rows.withColumn(f"u{j}", (place - inside) / n)
    return rows


def log_range(u: Column, low: float, high: float) -> Column:
    return F.exp(F.lit(math.log(low)) + F.lit(math.log(high / low)) * u)


def shrunk(n: Column, s: Column, mean: Column, lam: Column) -> Column:
    return (s + lam * mean) / (n + lam)


def fold_sums(rows: DataFrame) -> DataFrame:
    """outer, inner, g, n, s, q: counts, sums and sums of squares of y. rows: outer, inner, g, y; a null y takes no part."""
    return rows.filter("y is not null").groupBy("outer", "inner", "g").agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))


def inner_scores(sums: DataFrame, candidates: DataFrame) -> DataFrame:
    """fold, candidate, lam, score, chosen: the mean over inner folds of the RMSE on what each left out; the least wins, ties by candidate.

    sums: fold_sums of all rows; candidates (candidate, lam), which travel with the tasks.
    """
    folds = sums.select("outer").distinct().withColumnRenamed("outer", "fold")
    seen = sums.join(F.broadcast(folds), F.col("outer") != F.col("fold")).groupBy("fold", "inner", "g").agg(*[F.sum(c).alias(c) for c in "nsq"])
    group = Window.partitionBy("fold", "g")
    rest = seen.withColumns({"tn": F.sum("n").over(group) - F.col("n"), "ts": F.sum("s").over(group) - F.col("s")})
    whole = seen.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    left = seen.groupBy("fold", "inner").agg(F.sum("n").alias("vn"), F.sum("s").alias("vs")).join(whole, "fold")
    mean = left.select("fold", "inner", "vn", ((F.col("fs") - F.col("vs")) / (F.col("fn") - F.col("vn"))).alias("mean"))
    p = shrunk(F.col("tn"), F.col("ts"), F.col("mean"), F.col("lam"))
    sse = F.sum(F.col("q") - 2 * F.col("p") * F.col("s") + F.col("n") * F.col("p") * F.col("p"))
    each = rest.join(mean, ["fold", "inner"]).crossJoin(F.broadcast(candidates.select("candidate", "lam"))).withColumn("p", p)
    rmse = each.groupBy("fold", "inner", "candidate", "lam", "vn").agg(F.sqrt(F.greatest(F.lit(0.0), sse) / F.col("vn")).alias("rmse"))
    score = rmse.groupBy("fold", "candidate", "lam").agg(F.avg("rmse").alias("score"))
    first = F.row_number().over(Window.partitionBy("fold").orderBy("score", "candidate"))
    return score.withColumn("chosen", first == 1)


def out_of_fold(rows: DataFrame, key: list[str], candidates: DataFrame) -> DataFrame:
    """key, fold, lam, observed, prediction: each row forecast by the fit of the other outer folds at the lam that their inner folds chose."""
    sums = fold_sums(rows)
    best = inner_scores(sums, candidates).filter("chosen").select("fold", "lam")
    by_group = sums.groupBy("outer", "g").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = Window.partitionBy("g")
    whole = by_group.groupBy("outer").agg(F.sum("n").alias("on"), F.sum("s").alias("os"))
    total = whole.agg(F.sum("on").alias("an"), F.sum("os").alias("as_"))
    mean = whole.join(F.broadcast(total)).select(F.col("outer").alias("fold"), ((F.col("as_") - F.col("os")) / (F.col("an") - F.col("on"))).alias("mean"))
    rest = by_group.select(F.col("outer").alias("fold"), "g", (F.sum("n").over(every) - F.col("n")).alias("n"), (F.sum("s").over(every) - F.col("s")).alias("s"))
    fits = rest.join(F.broadcast(mean), "fold").join(F.broadcast(best), "fold").select("fold", "g", "lam", shrunk(F.col("n"), F.col("s"), F.col("mean"), F.col("lam")).alias("prediction"))
    return rows.filter("y is not null").withColumnRenamed("outer", "fold").join(fits, ["fold", "g"]).select(*key, "fold", "lam", F.col("y").alias("observed"), "prediction")


def metrics(df: DataFrame, observed: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """by, n, r2, rmse, mae; r2 is null where the observations do not differ."""
    e = F.col(observed) - F.col(predicted)
    syy = F.count(observed) * F.var_pop(observed)
    return df.groupBy(*by).agg(F.count(observed).alias("n"), F.when(syy > 0, 1 - F.sum(e * e) / syy).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def contract_faults(oof: DataFrame, key: str, scenarios: list[str]) -> DataFrame:
    """fault, n: what keeps out-of-fold rows (key, scenario, fold, observed, prediction, kind) from being compared; 0 for sound tables.

    Each key must have every scenario once, with one observation and one fold, finite values, and uncalibrated
    predictions (kind 'raw').
    """
    wrong = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    cell = oof.groupBy(key, "scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong("observed") | wrong("prediction")).alias("bad"), F.count_if(~F.col("kind").eqNullSafe("raw")).alias("calibrated"), F.min("observed").alias("lo"), F.max("observed").alias("hi"), F.min("fold").alias("f0"), F.max("fold").alias("f1"))
    one = cell.groupBy(key).agg(F.count_if(F.col("scenario").isin(scenarios)).alias("have"), F.count_if(~F.col("scenario").isin(scenarios) | F.col("scenario").isNull()).alias("other"), F.count_if(F.col("n") > 1).alias("twice"), F.sum("bad").alias("bad"), F.sum("calibrated").alias("calibrated"), (F.min("lo") != F.max("hi")).alias("unlike"), (F.min("f0") != F.max("f1")).alias("folds"))
    out = one.agg(F.count_if(F.col("have") < len(scenarios)).alias("missing scenario"), F.count_if(F.col("other") > 0).alias("unknown scenario"), F.count_if(F.col("twice") > 0).alias("repeated row"), F.count_if(F.col("bad") > 0).alias("not finite"), F.count_if(F.col("calibrated") > 0).alias("not raw"), F.count_if("unlike").alias("observations differ"), F.count_if("folds").alias("folds differ"), F.count_if(F.col(key).isNull()).alias("null key"))
    return out.unpivot([], out.columns, "fault", "n")
