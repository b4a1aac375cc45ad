"""Block bootstraps, regional ratios, contrasts and regression metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import block_id, draw
from veldt.operators.blocks import interval, plus_one_p, replicate_sums, weights
from veldt.operators.simulate import observation_bootstrap
from veldt.plans.cubes import SCORED, scored
from veldt.queries import query
from veldt.sources.tables import table

B = 40
#: A cell table: customers with a block, a zone, a class and an area.
CELLS = "cells as (select c_custkey cell, r_name as zone, c_custkey % 40 as block, case when c_acctbal >= 4500 then 'H' else 'L' end class, 1 + c_custkey % 7 as area from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.select(F.col("c_custkey").alias("cell"), F.col("r_name").alias("zone"), (F.col("c_custkey") % 40).alias("block"), F.when(F.col("c_acctbal") >= 4500, "H").otherwise("L").alias("class"), (1 + F.col("c_custkey") % 7).alias("area"))


def w_sql(unit: str, seed: int, blocks: str) -> str:
    u = f"{unit}, " if unit else ""
    p = f"partition by {unit} " if unit else ""
    q = f"partition by {unit}" if unit else ""
    j = f"r.{unit} = c.{unit} and " if unit else ""
    return f"rk as (select {u}block, row_number() over ({p}order by block) - 1 place, count(*) over ({q}) size from ({blocks})), dr as (select {u}rep, ('0x'||substr(md5('{seed}|'||rep||'|'||place), 1, 8))::bigint % size pick from rk, (select unnest(range(1, {B + 1})) rep)), ct as (select {u}rep, pick, count(*) w from dr group by all), wt as (select {'r.' + unit + ', ' if unit else ''}rep, block, w from ct c join rk r on {j}r.place = c.pick)"


@query("stat27_block_id", "select s_suppkey cell, floor(s_acctbal/500)::bigint || '_' || floor((s_suppkey % 37)/5.0)::bigint block from supplier")
def block_ids(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), block_id(F.col("s_acctbal"), F.col("s_suppkey") % 37, 1.0).alias("x"), F.concat_ws("_", F.floor(F.col("s_acctbal") / 500), F.floor((F.col("s_suppkey") % 37) / 5.0)).alias("block")).drop("x")


@query("stat28_boot_weights", f"with {CELLS}, {w_sql('zone', 7, 'select distinct zone, block from cells')} select zone, rep, block, w from wt")
def boot_weights(spark, d):
    return weights(cells(spark, d).select("zone", "block").distinct(), ["zone"], B, 7)


CUBE = f"{CELLS}, cube as (select block, zone, class, sum(area) a from cells group by 1, 2, 3)"


@query("agg07_cube", f"with {CELLS} select block, coalesce(zone, 'Overall') as zone, class, sum(area)::bigint area from cells group by grouping sets ((block, zone, class), (block, class))")
def cube(spark, d):
    return cells(spark, d).groupingSets([["block", "zone", "class"], ["block", "class"]], "block", "zone", "class").agg(F.sum("area").alias("area")).withColumn("zone", F.coalesce("zone", F.lit("Overall")))


@query("agg08_point_shares", f"with {CUBE} select zone, class, round(sum(a)/sum(sum(a)) over (partition by zone)::double, 6) share from cube group by 1, 2")
def shares(spark, d):
    g = cells(spark, d).groupBy("zone", "class").agg(F.sum("area").alias("a"))
    return g.select("zone", "class", F.round(F.col("a") / F.sum("a").over(Window.partitionBy("zone")), 6).alias("share"))


@query("agg09_block_counts", f"with {CELLS} select zone, count(distinct block) n_blocks, count(distinct block) filter (where class = 'H') n_high from cells where area > 0 group by 1")
def block_counts(spark, d):
    return cells(spark, d).filter("area > 0").groupBy("zone").agg(F.count_distinct("block").alias("n_blocks"), F.count_distinct(F.when(F.col("class") == "H", F.col("block"))).alias("n_high"))


BOOT = f"{CUBE}, {w_sql('zone', 7, 'select distinct zone, block from cells')}, rs as (select zone, rep, class, sum(w*a)::double a from cube join wt using (zone, block) group by 1, 2, 3), rp as (select zone, rep, class, a/sum(a) over (partition by zone, rep) prop from rs)"


def boot_shares(spark, d):
    c = cells(spark, d)
    stats = c.groupBy("zone", "block", "class").agg(F.sum("area").alias("a"))
    sums = replicate_sums(stats, weights(c.select("zone", "block").distinct(), ["zone"], B, 7), ["zone"], ["class"], ["a"])
    return sums.select("zone", "rep", "class", (F.col("a") / F.sum("a").over(Window.partitionBy("zone", "rep"))).alias("prop"))


@query("stat29_share_boot", f"with {BOOT} select zone, rep, class, round(prop, 6) prop from rp")
def share_boot(spark, d):
    return boot_shares(spark, d).withColumn("prop", F.round("prop", 6))


@query("stat31_area_ci", f"with {BOOT} select zone, class, round(quantile_cont(prop, 0.025), 6) low, round(median(prop), 6) median, round(quantile_cont(prop, 0.975), 6) high, count(*) valid from rp group by 1, 2")
def area_ci(spark, d):
    g = boot_shares(spark, d).groupBy("zone", "class").agg(*interval("prop"), F.count("prop").alias("valid"))
    return g.select("zone", "class", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")], "valid")


@query("stat32_contrast", f"with {BOOT}, pr as (select zone, rep, max(case when class = 'H' then prop end) - max(case when class = 'L' then prop end) delta from rp group by 1, 2) select zone, round(quantile_cont(delta, 0.025), 6) low, round(median(delta), 6) median, round(quantile_cont(delta, 0.975), 6) high, quantile_cont(delta, 0.025) > 0 or quantile_cont(delta, 0.975) < 0 excludes_zero from pr group by 1")
def contrast(spark, d):
    pr = boot_shares(spark, d).groupBy("zone", "rep").pivot("class", ["H", "L"]).agg(F.first("prop")).select("zone", "rep", (F.col("H") - F.col("L")).alias("delta"))
    g = pr.groupBy("zone").agg(*interval("delta"))
    return g.select("zone", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")], ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))


@query("stat30_global_boot", f"with {CUBE}, {w_sql('', 11, 'select distinct block from cells')}, rs as (select zone, rep, class, sum(w*a)::double a from cube join wt using (block) group by 1, 2, 3) select zone, rep, class, round(a/sum(a) over (partition by zone, rep), 6) prop from rs")
def global_boot(spark, d):
    c = cells(spark, d)
    stats = c.groupBy("zone", "block", "class").agg(F.sum("area").alias("a"))
    sums = stats.join(weights(c.select("block").distinct(), [], B, 11), "block").groupBy("zone", "rep", "class").agg(F.sum(F.col("w") * F.col("a")).cast("double").alias("a"))
    return sums.select("zone", "rep", "class", F.round(F.col("a") / F.sum("a").over(Window.partitionBy("zone", "rep")), 6).alias("prop"))


REG = f"{CELLS}, st as (select zone, block, sum(case when class = 'H' then area else 0 end)::double h, sum(area)::double a from cells group by 1, 2), {w_sql('zone', 13, 'select distinct zone, block from cells')}, rg as (select coalesce(zone, 'Overall') as zone, rep, sum(w*h)/sum(w*a) v from st join wt using (zone, block) group by grouping sets ((zone, rep), (rep)))"


def regional_ratio(spark, d):
    c = cells(spark, d)
    st = c.groupBy("zone", "block").agg(F.sum(F.when(F.col("class") == "H", F.col("area")).otherwise(0)).cast("double").alias("h"), F.sum("area").cast("double").alias("a"))
    j = st.join(weights(c.select("zone", "block").distinct(), ["zone"], B, 13), ["zone", "block"])
    g = j.groupingSets([["zone", "rep"], ["rep"]], "zone", "rep").agg((F.sum(F.col("w") * F.col("h")) / F.sum(F.col("w") * F.col("a"))).alias("v"))
    return g.withColumn("zone", F.coalesce("zone", F.lit("Overall")))


@query("stat39_regional_boot", f"with {REG} select zone, rep, round(v, 6) v from rg")
def regional_boot(spark, d):
    return regional_ratio(spark, d).withColumn("v", F.round("v", 6))


@query("stat40_pairwise", f"with {REG}, est as (select zone, sum(h)/sum(a) e from st group by 1), pr as (select x.zone z1, y.zone z2, x.v - y.v v, (select e from est where est.zone = x.zone) - (select e from est where est.zone = y.zone) e from rg x join rg y on x.rep = y.rep and x.zone < y.zone where x.zone <> 'Overall' and y.zone <> 'Overall') select z1, z2, round(any_value(e), 6) est, round((1 + sum(case when abs(v - e) >= abs(e) then 1 else 0 end))/(1e0 + count(*)), 6) p from pr group by 1, 2")
def pairwise(spark, d):
    r = regional_ratio(spark, d).filter("zone <> 'Overall'")
    e = cells(spark, d).groupBy("zone").agg((F.sum(F.when(F.col("class") == "H", F.col("area")).otherwise(0)) / F.sum("area")).alias("e"))
    side = lambda k: r.join(F.broadcast(e), "zone").select("rep", F.col("zone").alias(f"z{k}"), F.col("v").alias(f"v{k}"), F.col("e").alias(f"e{k}"))
    pr = side(1).join(side(2), "rep").filter("z1 < z2").select("z1", "z2", (F.col("v1") - F.col("v2")).alias("v"), (F.col("e1") - F.col("e2")).alias("e"))
    return pr.groupBy("z1", "z2").agg(F.round(F.first("e"), 6).alias("est"), F.round(plus_one_p(F.col("v"), F.col("e")), 6).alias("p"))


@query("agg15_robustness", f"with {REG}, dl as (select zone, rep, v - avg(v) over (partition by rep) dv from rg where zone <> 'Overall') select zone, count(*) n, count(*) filter (where dv > 0) pos, count(*) filter (where dv < 0) neg, round(min(dv), 6) lo, round(max(dv), 6) hi, bool_and(dv > 0) or bool_and(dv < 0) direction_robust, greatest(count(*) filter (where dv > 0), count(*) filter (where dv < 0)) >= 0.8*count(*) mostly from dl group by 1")
def robustness(spark, d):
    r = regional_ratio(spark, d).filter("zone <> 'Overall'")
    dl = r.select("zone", (F.col("v") - F.avg("v").over(Window.partitionBy("rep"))).alias("dv"))
    pos, neg = F.count_if(F.col("dv") > 0), F.count_if(F.col("dv") < 0)
    return dl.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), pos.alias("pos"), neg.alias("neg"), F.round(F.min("dv"), 6).alias("lo"), F.round(F.max("dv"), 6).alias("hi"), (F.bool_and(F.col("dv") > 0) | F.bool_and(F.col("dv") < 0)).alias("direction_robust"), (F.greatest(pos, neg) >= 0.8 * F.count(F.lit(1))).alias("mostly"))


def metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """n, r2 (null for a constant y), rmse, mae."""
    e = F.col(y) - F.col(p)
    g = df.groupBy(*keys).agg(F.count(y).alias("n"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return g.select(*keys, "n", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"), "rmse", "mae")


LONG = f"{SCORED}, lg as (unpivot (select plot, y, c_mktsegment, o_custkey, p1, p2, p3 from scored) on p1, p2, p3 into name scenario value p)"


def long(spark, d):
    return scored(spark, d).unpivot(["plot", "y", "c_mktsegment", "o_custkey"], ["p1", "p2", "p3"], "scenario", "p")


@query("agg16_metrics", f"with {LONG} select scenario, c_mktsegment, count(*) n, round(1 - sum((y-p)^2)/(var_pop(y)*count(*)), 6) r2, round(sqrt(avg((y-p)^2)), 4) rmse, round(avg(abs(y-p)), 4) mae from lg group by 1, 2")
def regression(spark, d):
    return metrics(long(spark, d), ["scenario", "c_mktsegment"], "y", "p").select("scenario", "c_mktsegment", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("agg17_pooled_r2", f"with {LONG} select scenario, case when count(*) >= 10 then round(1 - sum((y-p)^2)/(var_pop(y)*count(*)), 6) end r2 from lg group by 1")
def pooled(spark, d):
    return metrics(long(spark, d), ["scenario"], "y", "p").select("scenario", F.round(F.when(F.col("n") >= 10, F.col("r2")), 6).alias("r2"))


@query("agg18_calibration", f"with {LONG} select scenario, round(corr(y, p), 6) r, round(avg(p - y), 4) me, round(stddev_samp(p)/stddev_samp(y), 6) sd_ratio, round(regr_slope(y, p), 6) slope, round(regr_intercept(y, p), 2) intercept, round(quantile_cont(y, 0.9), 4) y90, round(quantile_cont(p, 0.9)/quantile_cont(y, 0.9), 6) ratio90 from lg group by 1")
def calibrated(spark, d):
    return long(spark, d).groupBy("scenario").agg(F.round(F.corr("y", "p"), 6).alias("r"), F.round(F.avg(F.col("p") - F.col("y")), 4).alias("me"), F.round(F.stddev_samp("p") / F.stddev_samp("y"), 6).alias("sd_ratio"), F.round(F.regr_slope("y", "p"), 6).alias("slope"), F.round(F.regr_intercept("y", "p"), 2).alias("intercept"), F.round(F.percentile("y", 0.9), 4).alias("y90"), F.round(F.percentile("p", 0.9) / F.percentile("y", 0.9), 6).alias("ratio90"))


@query("agg20_pinball", f"with {LONG}, q as (select unnest([0.05, 0.5, 0.95])::double q) select scenario, q, round(avg(greatest(q*(y-p), (q-1)*(y-p))), 4) pinball, round(avg(case when y <= p then 1e0 else 0 end), 6) coverage from lg, q group by 1, 2")
def pinball(spark, d):
    g = long(spark, d).withColumn("q", F.explode(F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))).withColumn("e", F.col("y") - F.col("p"))
    return g.groupBy("scenario", "q").agg(F.round(F.avg(F.greatest(F.col("q") * F.col("e"), (F.col("q") - 1) * F.col("e"))), 4).alias("pinball"), F.round(F.avg(F.when(F.col("y") <= F.col("p"), 1.0).otherwise(0.0)), 6).alias("coverage"))


R2B = f"{LONG}, bs as (select scenario, o_custkey % 40 as block, count(*)::double n, sum(y) sy, sum(y*y) syy, sum((y-p)^2) sse from lg group by 1, 2), {w_sql('', 17, 'select distinct block from bs')}, r2 as (select scenario, rep, 1 - sum(w*sse)/(sum(w*syy) - sum(w*sy)^2/sum(w*n)) r2 from bs join wt using (block) group by 1, 2)"


def r2_reps(spark, d):
    e = F.col("y") - F.col("p")
    bs = long(spark, d).groupBy("scenario", (F.col("o_custkey") % 40).alias("block")).agg(F.count("y").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(e * e).alias("sse"))
    sums = bs.join(weights(bs.select("block").distinct(), [], B, 17), "block").groupBy("scenario", "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "sy", "syy", "sse")])
    return sums.select("scenario", "rep", (1 - F.col("sse") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"))


@query("stat37_r2_block_boot", f"with {R2B} select scenario, round(quantile_cont(r2, 0.025), 6) low, round(median(r2), 6) median, round(quantile_cont(r2, 0.975), 6) high from r2 group by 1")
def r2_boot(spark, d):
    g = r2_reps(spark, d).groupBy("scenario").agg(*interval("r2"))
    return g.select("scenario", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


@query("stat38_contrasts", f"with {R2B}, df as (select * from (values ('removal', 'p2', 'p1'), ('marginal', 'p3', 'p1'), ('substitution', 'p3', 'p2')) v(kind, a, b)), dl as (select kind, x.r2 - y.r2 dv from df join r2 x on x.scenario = a join r2 y on y.scenario = b and y.rep = x.rep) select kind, round(quantile_cont(dv, 0.025), 6) low, round(median(dv), 6) median, round(quantile_cont(dv, 0.975), 6) high from dl group by 1")
def r2_contrasts(spark, d):
    r = r2_reps(spark, d)
    dim = spark.createDataFrame([("removal", "p2", "p1"), ("marginal", "p3", "p1"), ("substitution", "p3", "p2")], "kind string, a string, b string")
    side = lambda k: r.select("rep", F.col("scenario").alias(k), F.col("r2").alias(f"r{k}"))
    dl = F.broadcast(dim).join(side("a"), "a").join(side("b"), ["b", "rep"]).select("kind", (F.col("ra") - F.col("rb")).alias("dv"))
    g = dl.groupBy("kind").agg(*interval("dv"))
    return g.select("kind", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


@query("stat36_obs_boot", f"with {LONG}, s as (select scenario, count(*)::double n, sum(y) sy, sum(y*y) syy, sum((y-p)^2) sse from (select *, unnest(range(1, 11)) rep from lg) where ('0x'||substr(md5('o|'||rep||'|'||plot), 1, 8))::bigint % 2 = 0 group by scenario, rep) select scenario, round(min(1 - sse/(syy - sy*sy/n)), 6) lo, round(max(1 - sse/(syy - sy*sy/n)), 6) hi from s group by 1")
def obs_boot(spark, d):
    """Half samples keyed by (replicate, plot): sums alone cross the shuffle."""
    e = F.col("y") - F.col("p")
    s = long(spark, d).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(10)))).filter(draw("o", F.col("rep"), F.col("plot")) % 2 == 0).groupBy("scenario", "rep").agg(F.count("y").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(e * e).alias("sse"))
    r2 = 1 - F.col("sse") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    return s.groupBy("scenario").agg(F.round(F.min(r2), 6).alias("lo"), F.round(F.max(r2), 6).alias("hi"))


@query("stat36_obs_bootstrap")
def obs_bootstrap(spark, d):
    """R2 of each prediction and its differences over all rows: 2000 Poisson replicates, percentile bounds from 100 finite ones on, plus-one p of differences."""
    return summarised(observation_bootstrap(scored(spark, d), "plot", "y", ["p1", "p2", "p3"]))


def summarised(sums: DataFrame) -> DataFrame:
    """name, estimate, low, high, p, n_boot, n_obs."""
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = lambda p: F.when(sst > 0, 1 - F.col(f"e_{p}") / sst)
    diff = lambda a, b: F.when(sst > 0, (F.col(f"e_{b}") - F.col(f"e_{a}")) / sst)
    kinds = [("p1", r2("p1")), ("p2", r2("p2")), ("p3", r2("p3")), ("p2-p1", diff("p2", "p1")), ("p3-p1", diff("p3", "p1")), ("p3-p2", diff("p3", "p2"))]
    v = sums.select("rep", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), x.alias("v")) for k, x in kinds])).alias("x")).select("rep", "n", "x.*")
    drawn = F.when(F.col("rep") > 0, F.col("v"))
    g = v.groupBy("name").agg(F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("estimate"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), F.count(drawn).alias("n_boot"), F.count_if(drawn <= 0).alias("left"), F.count_if(drawn >= 0).alias("right"), F.max(F.when(F.col("rep") == 0, F.col("n"))).cast("long").alias("n_obs"))
    ready = (F.col("n_boot") >= 100) & (F.col("n_obs") >= 10)
    p = F.least(F.lit(1.0), 2 * (F.least("left", "right") + 1) / (F.col("n_boot") + 1))
    return g.select("name", F.when(F.col("n_obs") >= 10, F.col("estimate")).alias("estimate"), F.when(ready, F.col("low")).alias("low"), F.when(ready, F.col("high")).alias("high"), F.when(ready & F.contains("name", F.lit("-")), p).alias("p"), "n_boot", "n_obs")


@query("stat58_folds", "with u as (select distinct o_custkey id from orders), r as (select id, row_number() over (order by md5('1|'||id), id) - 1 k from u) select id, (k % 5)::int fold from r")
def folds(spark, d):
    """Grouped folds in a keyed order: ranks within 256 key ranges plus the ranges' offsets, so that no task ranks all ids."""
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit("1"), "id"))).withColumn("part", F.substring("h", 1, 2))
    sizes = u.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n"))
    r = u.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("h", "id")) - 1).join(F.broadcast(sizes), "part")
    return r.select("id", ((F.col("k") + F.col("before")) % 5).cast("int").alias("fold"))
