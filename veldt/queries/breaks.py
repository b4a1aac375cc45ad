"""Break-year, exceedance and spatial-agreement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import draw
from veldt.operators.breaks import exceedance, hinge_fits
from veldt.plans.cubes import ZONES, zones
from veldt.queries import query
from veldt.sources.tables import table

FIRST, LAST = 1, 20


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """cell (supplier), t 1..20 (twentieths of the order keys), v with a hinge planted at 8 on every third cell."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity")
    g = li.groupBy((F.col("l_suppkey") % 60).cast("int").alias("cell"), (F.col("l_orderkey") % 20 + 1).cast("int").alias("t")).agg(F.avg("l_quantity").alias("v"))
    planted = F.when(F.col("cell") % 3 == 0, -2.0 * F.col("t") + 5.0 * F.greatest(F.col("t") - 8, F.lit(0))).otherwise(0.0)
    return g.withColumn("v", F.round(F.col("v") + planted, 6))


YEARLY = "yearly as (select (l_suppkey % 60)::int cell, (l_orderkey % 20 + 1)::int t, round(avg(l_quantity) + case when (l_suppkey % 60) % 3 = 0 then -2.0*(l_orderkey % 20 + 1) + 5.0*greatest(l_orderkey % 20 + 1 - 8, 0) else 0 end, 6)::double v from lineitem group by (l_suppkey % 60), (l_orderkey % 20 + 1))"
FITS = f"""{YEARLY}, base as (select cell, count(*) n, regr_slope(v, t) b, greatest(0, regr_syy(v,t) - regr_sxy(v,t)^2/regr_sxx(v,t)) sse0 from yearly group by 1 having count(*) = 20),
yrs as (select unnest(range(1, 21))::double y), cand as (select unnest(range(5, 16))::int tau),
hr as (select tau, y, greatest(0, y - tau)::double h from cand, yrs), hc as (select tau, regr_slope(h, y) s, regr_intercept(h, y) i from hr group by 1), hp as (select tau, y, h - i - s*y h, s from hr join hc using (tau)), hh as (select tau, sum(h*h) hh, any_value(s) s from hp group by 1),
fit as (select cell, tau, sum(v*h) yh from yearly join hp on y = t group by 1, 2),
sse as (select fit.cell, tau, sse0, greatest(0, sse0 - yh*yh/hh) sse1, yh/hh step, b - yh/hh*s sb from fit join hh using (tau) join base on base.cell = fit.cell),
best as (select * from sse qualify row_number() over (partition by cell order by sse1, tau) = 1), fin as (select *, 17*(sse0-sse1)/sse1 supf from best)"""


def fits(spark, d):
    return hinge_fits(yearly(spark, d), FIRST, LAST)


@query("stat12_hinge_supf", f"with {FITS} select cell, tau, round(supf, 5) supf from fin")
def supf(spark, d):
    return fits(spark, d).select("cell", "tau", F.round("supf", 5).alias("supf"))


@query("stat14_direction", f"with {FITS} select cell, tau, round(sb, 6) slope_before, round(sb+step, 6) slope_after, sb < -1e-12 and sb+step > 1e-12 direction_ok from fin")
def direction(spark, d):
    return fits(spark, d).select("cell", "tau", F.round("slope_before", 6).alias("slope_before"), F.round("slope_after", 6).alias("slope_after"), "direction_ok")


@query("agg33_break_distribution", f"with {FITS} select tau, count(*) n, round(count(*)/sum(count(*)) over ()::double, 6) share, round(count(*)/sum(count(*)) over ()::double*11, 6) to_uniform from fin where sb < -1e-12 and sb+step > 1e-12 group by tau")
def distribution(spark, d):
    g = fits(spark, d).filter("direction_ok").groupBy("tau").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.select("tau", "n", F.round(share, 6).alias("share"), F.round(share * 11, 6).alias("to_uniform"))


NULLS = "nul as (select ('0x'||substr(md5('null|'||event_id), 1, 8))::bigint/4294967296e0*60 stat from events where event_id < 999)"


def null_table(spark, d):
    return table(spark, d, "events").filter("event_id < 999").select((draw("null", F.col("event_id")) / 4294967296.0 * 60).alias("stat"))


@query("stat18_mc_p", f"with {FITS}, {NULLS} select cell, (select count(*) from nul where stat >= supf) k, round((1 + (select count(*) from nul where stat >= supf))/1000e0, 6) p from fin")
def mc_p(spark, d):
    return exceedance(fits(spark, d).select("cell", F.col("supf").alias("stat")), null_table(spark, d), 999).select("cell", "k", F.round("p", 6).alias("p"))


@query("join14_mc_rank", f"with {NULLS}, obs as (select user_id cell, max(value) stat from events group by 1) select cell, round(stat, 6) stat, (select count(*) from nul where nul.stat >= obs.stat) k from obs")
def rank_join(spark, d):
    obs = table(spark, d, "events").groupBy(F.col("user_id").alias("cell")).agg(F.max("value").alias("stat"))
    return exceedance(obs, null_table(spark, d), 999).select("cell", F.round("stat", 6).alias("stat"), "k")


@query("agg34_exceedance_histogram", f"with {FITS}, {NULLS}, o as (select (select count(*) from nul where stat >= supf) k from fin) select k, count(*) n from o group by 1")
def histogram(spark, d):
    return exceedance(fits(spark, d).select("cell", F.col("supf").alias("stat")), null_table(spark, d), 999).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("stat19_calibration_summary", f"with {NULLS} select round(quantile_disc(stat, 0.90), 6) c90, round(quantile_disc(stat, 0.95), 6) c95, round(quantile_disc(stat, 0.99), 6) c99, round(avg(stat), 6) mean, round(median(stat), 6) median, count(*) n from nul")
def calibration(spark, d):
    disc = lambda p, a: F.round(F.expr(f"percentile_disc({p}) within group (order by stat)"), 6).alias(a)
    return null_table(spark, d).agg(disc(0.90, "c90"), disc(0.95, "c95"), disc(0.99, "c99"), F.round(F.avg("stat"), 6).alias("mean"), F.round(F.median("stat"), 6).alias("median"), F.count(F.lit(1)).alias("n"))


@query("agg46_ols", f"with {YEARLY} select cell, round(regr_intercept(v, t), 6) intercept, round(regr_slope(v, t), 6) slope, round(greatest(0, regr_syy(v,t) - regr_sxy(v,t)^2/regr_sxx(v,t)), 5) sse from yearly group by 1")
def ols(spark, d):
    y = yearly(spark, d).groupBy("cell").agg(F.regr_intercept("v", "t").alias("i"), F.regr_slope("v", "t").alias("s"), F.regr_syy("v", "t").alias("yy"), F.regr_sxy("v", "t").alias("xy"), F.regr_sxx("v", "t").alias("xx"))
    return y.select("cell", F.round("i", 6).alias("intercept"), F.round("s", 6).alias("slope"), F.round(F.greatest(F.lit(0.0), F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")), 5).alias("sse"))


@query("win03_lag1", f"with {YEARLY}, r as (select cell, t, v - regr_intercept(v, t) over (partition by cell) - regr_slope(v, t) over (partition by cell)*t e from yearly), l as (select *, lead(e) over (partition by cell order by t) f from r) select cell, round(sum(e*f)/sqrt(sum(e*e) filter (where f is not null)*sum(f*f)), 6) rho from l group by 1")
def lag1(spark, d):
    c = Window.partitionBy("cell")
    r = yearly(spark, d).select("cell", "t", (F.col("v") - F.regr_intercept("v", "t").over(c) - F.regr_slope("v", "t").over(c) * F.col("t")).alias("e")).withColumn("f", F.lead("e").over(c.orderBy("t"))).filter("f is not null")
    return r.groupBy("cell").agg(F.round(F.sum(F.col("e") * F.col("f")) / F.sqrt(F.sum(F.col("e") * F.col("e")) * F.sum(F.col("f") * F.col("f"))), 6).alias("rho"))


@query("stat20_rho", f"with {YEARLY}, r as (select cell, t, v - regr_intercept(v, t) over (partition by cell) - regr_slope(v, t) over (partition by cell)*t e from yearly), l as (select *, lead(e) over (partition by cell order by t) f from r), g as (select cell, sum(e*f)/sqrt(sum(e*e) filter (where f is not null)*sum(f*f)) rho from l group by 1) select count(*) n, round(median(rho), 6) rho from g")
def rho(spark, d):
    c = Window.partitionBy("cell")
    r = yearly(spark, d).select("cell", "t", (F.col("v") - F.regr_intercept("v", "t").over(c) - F.regr_slope("v", "t").over(c) * F.col("t")).alias("e")).withColumn("f", F.lead("e").over(c.orderBy("t"))).filter("f is not null")
    g = r.groupBy("cell").agg((F.sum(F.col("e") * F.col("f")) / F.sqrt(F.sum(F.col("e") * F.col("e")) * F.sum(F.col("f") * F.col("f")))).alias("rho"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.median("rho"), 6).alias("rho"))


@query("stat22_margins", f"with {YEARLY}, base as (select cell, greatest(0, regr_syy(v,t) - regr_sxy(v,t)^2/regr_sxx(v,t)) sse0 from yearly group by 1 having count(*) = 20), yrs as (select unnest(range(1, 21))::double y), cand as (select unnest(range(2, 19))::int tau), hr as (select tau, y, greatest(0, y - tau)::double h from cand, yrs), hc as (select tau, regr_slope(h, y) s, regr_intercept(h, y) i from hr group by 1), hp as (select tau, y, h - i - s*y h from hr join hc using (tau)), hh as (select tau, sum(h*h) hh from hp group by 1), fit as (select cell, tau, sum(v*h) yh from yearly join hp on y = t group by 1, 2), sse as (select fit.cell, tau, sse0, greatest(0, sse0 - yh*yh/hh) sse1 from fit join hh using (tau) join base on base.cell = fit.cell), m as (select unnest([2, 3, 4, 5])::int margin), best as (select margin, sse.* from sse, m where tau between margin and 20 - margin qualify row_number() over (partition by margin, cell order by sse1, tau) = 1) select margin, cell, tau, round(17*(sse0-sse1)/sse1, 5) supf from best")
def margins(spark, d):
    y, out = yearly(spark, d), None
    for m in (2, 3, 4, 5):
        one = hinge_fits(y, FIRST, LAST, m).select(F.lit(m).alias("margin"), "cell", "tau", F.round("supf", 5).alias("supf"))
        out = one if out is None else out.union(one)
    return out


@query("agg38_year_agreement", f"with {FITS}, two as (select a.cell, a.tau t1, b.tau t2 from fin a join fin b on b.cell = (a.cell + 3) % 60) select count(*) n, round(avg(case when t1 = t2 then 1e0 else 0 end), 6) exact, round(avg(case when abs(t1-t2) <= 1 then 1e0 else 0 end), 6) within1, round(avg(abs(t1-t2)), 6) mean_shift, median(abs(t1-t2))::double median_shift from two")
def agreement(spark, d):
    f = fits(spark, d).select("cell", "tau")
    two = f.select("cell", F.col("tau").alias("t1"), ((F.col("cell") + 3) % 60).alias("o")).join(f.select(F.col("cell").alias("o"), F.col("tau").alias("t2")), "o")
    s = F.abs(F.col("t1") - F.col("t2"))
    return two.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(s == 0, 1.0).otherwise(0.0)), 6).alias("exact"), F.round(F.avg(F.when(s <= 1, 1.0).otherwise(0.0)), 6).alias("within1"), F.round(F.avg(s), 6).alias("mean_shift"), F.median(s).cast("double").alias("median_shift"))


@query("agg29_mode", f"with {FITS}, g as (select cell % 5 as grp, tau, count(*) n from fin group by 1, 2) select grp, tau mode_year, n from g qualify row_number() over (partition by grp order by n desc, tau) = 1")
def mode(spark, d):
    g = fits(spark, d).groupBy((F.col("cell") % 5).alias("grp"), "tau").agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("k"), "tau")).alias("b"))
    return best.select("grp", F.col("b.tau").alias("mode_year"), (-F.col("b.k")).alias("n"))


@query("agg30_weighted_quantile", f"with {FITS}, g as (select tau, count(*) n from fin group by 1), c as (select tau, sum(n) over (order by tau) cum, sum(n) over () tot from g), p as (select unnest([0.25, 0.5, 0.75])::double p) select p, min(tau) tau from c, p where cum >= p*tot group by 1")
def weighted_quantile(spark, d):
    g = fits(spark, d).groupBy("tau").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    c = g.withColumn("cum", F.sum("n").over(w.orderBy("tau"))).withColumn("tot", F.sum("n").over(w)).withColumn("p", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return c.filter(F.col("cum") >= F.col("p") * F.col("tot")).groupBy("p").agg(F.min("tau").alias("tau"))


@query("agg39_jackknife", f"with {FITS}, b as (select cell % 6 as block, tau from fin), ids as (select distinct block from b) select ids.block, count(*) n, median(tau)::double median_year, round(median(tau)::double - (select median(tau) from b), 6) shift from ids join b on b.block <> ids.block group by 1")
def jackknife(spark, d):
    """Leave one block out: counts of years by block are subtracted from the total, so rows are never repeated."""
    c = fits(spark, d).groupBy((F.col("cell") % 6).alias("block"), "tau").agg(F.count(F.lit(1)).alias("k"))
    total = c.groupBy("tau").agg(F.sum("k").alias("all"))
    left = c.select("block").distinct().join(F.broadcast(total)).join(c, ["block", "tau"], "left").withColumn("m", F.col("all") - F.coalesce("k", F.lit(0))).filter("m > 0")
    whole = total.agg(F.expr("percentile(tau, 0.5D, all)").alias("whole"))
    g = left.groupBy("block").agg(F.sum("m").alias("n"), F.expr("percentile(tau, 0.5D, m)").alias("median_year"))
    return g.join(F.broadcast(whole)).select("block", "n", "median_year", F.round(F.col("median_year") - F.col("whole"), 6).alias("shift"))


@query("agg35_regional_summary", f"with {FITS}, {ZONES}, p as (select fin.*, zone from fin join zones on zones.cell = fin.cell % 25), m as (select zone, tau, count(*) k from p where sb < -1e-12 and sb+step > 1e-12 group by 1, 2 qualify row_number() over (partition by zone order by count(*) desc, tau) = 1) select p.zone, count(*) eligible, count(*) filter (where supf >= 20) significant, count(*) filter (where supf >= 20 and sb < -1e-12 and sb+step > 1e-12) recovery, any_value(m.tau) mode_year from p left join m using (zone) group by 1")
def regional(spark, d):
    p = fits(spark, d).join(F.broadcast(zones(spark, d).withColumnRenamed("cell", "z")), F.col("cell") % 25 == F.col("z"))
    k = lambda c: F.sum(F.when(c, 1).otherwise(0))
    m = p.filter("direction_ok").groupBy("zone", "tau").count().groupBy("zone").agg(F.min(F.struct((-F.col("count")).alias("k"), "tau")).alias("b")).select("zone", F.col("b.tau").alias("mode_year"))
    return p.groupBy("zone").agg(F.count(F.lit(1)).alias("eligible"), k(F.col("supf") >= 20).alias("significant"), k((F.col("supf") >= 20) & F.col("direction_ok")).alias("recovery")).join(m, "zone", "left")


@query("srt04_tie_rule", f"with {FITS}, b as (select cell, min(sse1) m from sse group by 1) select cell, min(tau) earliest, max(tau) latest, count(*) ties from sse join b using (cell) where sse1 <= m*1.05 group by 1")
def ties(spark, d):
    """Candidates within five per cent of the least sum of squares: the earliest and the latest."""
    from veldt.operators.breaks import hinges

    y = yearly(spark, d)
    base = y.groupBy("cell").agg(F.count("v").alias("n"), F.regr_syy("v", "t").alias("yy"), F.regr_sxy("v", "t").alias("xy"), F.regr_sxx("v", "t").alias("xx")).filter(F.col("n") == LAST)
    dots = y.join(F.broadcast(hinges(spark, FIRST, LAST, 5)), "t").groupBy("cell", "tau").agg(F.sum(F.col("v") * F.col("h")).alias("yh"), F.first("hh").alias("hh"))
    sse = dots.join(base, "cell").withColumn("sse1", F.greatest(F.lit(0.0), F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx") - F.col("yh") * F.col("yh") / F.col("hh")))
    s = sse.withColumn("m", F.min("sse1").over(Window.partitionBy("cell")))
    return s.filter(F.col("sse1") <= F.col("m") * 1.05).groupBy("cell").agg(F.min("tau").alias("earliest"), F.max("tau").alias("latest"), F.count(F.lit(1)).alias("ties"))
