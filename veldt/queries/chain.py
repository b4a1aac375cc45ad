"""The break test from fits to classes: bias-corrected autocorrelation, null table, p, discrete FDR; six classes by adjusted q."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.scalars import ratio
from veldt.operators import calibration, fdr, ranges, trend
from veldt.operators.breaks import exceedance, hinge_fits
from veldt.operators.series import complete, pack
from veldt.plans.cubes import SERIES
from veldt.queries import query
from veldt.queries.breaks import FIRST, FITS, LAST, YEARLY, yearly
from veldt.queries.trend import ADJ, ALL6
from veldt.sources.shared import cut
from veldt.sources.tables import table

#: Grid of the bias map, its draws, draws of the null, largest rho.
GRID_RHO = [-0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8]
B_BIAS, B_NULL, MOST = 99, 199, 0.95
STEPS = LAST - FIRST + 1


def _noise_sql(tag: str, draws: int) -> str:
    u = [f"((('0x'||substr(md5('{tag}|'||b||'|'||t||'|{j}'), 1, 8))::bigint + 0.5)/4294967296e0)" for j in (1, 2)]
    return f"noise_{tag} as (select b, t, sqrt(-2*ln({u[0]}))*cos(2*pi()*{u[1]}) e from (select unnest(range(1, {draws + 1})) b), (select unnest(range(1, {STEPS + 1}))::int t))"


def _ar1_sql(name: str, tag: str, rhos: str) -> str:
    """rhos: a table (g, rho)."""
    return f"{name} as (select g, rho, x.b, y.t, sum(pow(rho, y.t - x.t)*case when x.t = 1 then 1 else sqrt(1 - rho*rho) end*e) v from noise_{tag} x join (select unnest(range(1, {STEPS + 1}))::int t) y on x.t <= y.t, {rhos} group by 1, 2, 3, 4)"


def _lag1_sql(name: str, source: str, by: str) -> str:
    return f"""{name}_r as (select {by}, t, v - regr_intercept(v, t) over (partition by {by}) - regr_slope(v, t) over (partition by {by})*t e from {source}),
{name}_l as (select *, lead(e) over (partition by {by} order by t) f from {name}_r), {name} as (select {by}, sum(e*f)/sqrt(sum(e*e) filter (where f is not null)*sum(f*f)) rho from {name}_l group by {by})"""


RAW = f"{YEARLY}, {_lag1_sql('cell_rho', 'yearly', 'cell')}, raw_rho as (select median(rho) rho from cell_rho)"
BIAS = f"""{_noise_sql('bias', B_BIAS)}, grid_rho as (select unnest({GRID_RHO})::double rho, unnest(range(1, {len(GRID_RHO) + 1})) g), {_ar1_sql('known', 'bias', 'grid_rho')}, {_lag1_sql('seen', 'known', 'rho, b').replace('sum(e*f)/sqrt(sum(e*e) filter (where f is not null)*sum(f*f)) rho', 'sum(e*f)/sqrt(sum(e*e) filter (where f is not null)*sum(f*f)) est')},
mid as (select rho true_rho, median(est) estimated from seen group by 1), cum as (select *, row_number() over (order by true_rho) i, sum(estimated) over (order by true_rho) cs from mid),
stretch as (select a.i a, b.i b, (b.cs - a.cs + a.estimated)/(b.i - a.i + 1) m from cum a join cum b on a.i <= b.i), least as (select a, b, min(m) over (partition by a order by b desc) m from stretch),
bias as (select true_rho, estimated, iso from cum join (select b, max(m) iso from least group by 1) on b = i)"""
CORRECTED = f"""{RAW}, {BIAS}, once as (select iso x, median(true_rho) y from bias group by 1), kn as (select *, lead(x) over (order by x) x1, lead(y) over (order by x) y1 from once),
fixed as (select rho raw, greatest(-{MOST}, least({MOST}, case when rho < (select min(x) from kn) then (select arg_min(y, x) from kn) else (select case when x1 is null then y else y + (rho - x)/(x1 - x)*(y1 - y) end from kn where x <= rho order by x desc limit 1) end)) rho from raw_rho)"""


@query("stat21_corrected_cells", f"with {RAW}, {BIAS}, once as (select iso x, median(true_rho) y from bias group by 1), kn as (select *, lead(x) over (order by x) x1, lead(y) over (order by x) y1 from once) select cell, round(rho, 6) rho, round(greatest(-{MOST}, least({MOST}, case when x is null then (select arg_min(y, x) from kn) when x1 is null then y else y + (rho - x)/(x1 - x)*(y1 - y) end)), 6) corrected from cell_rho left join kn on rho >= x and (x1 is null or rho < x1)")
def corrected_cells(spark, d):
    """Every cell's residual autocorrelation through the bias map: the inverse of a monotone fit to known series."""
    raw = calibration.lag1_of_residuals(yearly(spark, d), ["cell"])
    return calibration.correct_rho(raw, cut(bias_table(spark)), MOST).select("cell", F.round("rho", 6).alias("rho"), F.round("corrected", 6).alias("corrected"))


def bias_table(spark: SparkSession) -> DataFrame:
    return calibration.bias_map(spark, GRID_RHO, B_BIAS, FIRST, LAST)


def corrected(spark: SparkSession, d: str) -> DataFrame:
    """One row: rho as the cells' residuals have it, and corrected."""
    raw = calibration.lag1_of_residuals(yearly(spark, d), ["cell"]).agg(F.median("rho").alias("rho"))
    return cut(calibration.correct_rho(raw, bias_table(spark), MOST))


@query("stat20_rho_corrected", f"with {CORRECTED} select round(raw, 6) raw, round(rho, 6) corrected from fixed")
def rho_corrected(spark, d):
    return corrected(spark, d).select(F.round("rho", 6).alias("raw"), F.round("corrected", 6).alias("corrected"))


#: The fits of FITS for the null's series, from the same projected hinges.
_nf = f"""nbase as (select cell, regr_slope(v, t) b, greatest(0, regr_syy(v,t) - regr_sxy(v,t)^2/regr_sxx(v,t)) sse0 from null_series group by 1),
nfit as (select cell, tau, sum(v*h) yh from null_series join hp on y = t group by 1, 2), nsse as (select nfit.cell, tau, sse0, greatest(0, sse0 - yh*yh/hh) sse1 from nfit join hh using (tau) join nbase on nbase.cell = nfit.cell),
nul as (select cell, max(17*(sse0 - sse1)/sse1) stat from nsse group by 1)"""
CHAIN = f"{CORRECTED}, {FITS.replace(YEARLY + ', ', '')}, {_noise_sql('null', B_NULL)}, {_ar1_sql('null_ar', 'null', '(select 1 g, rho from fixed)')}, null_series as (select b cell, t, v from null_ar), {_nf}"


def null_stats(spark: SparkSession, rho: DataFrame, scenario: list[str] = ()) -> DataFrame:
    """scenario, draw, stat: the largest F of B_NULL series for each row of rho (scenario, rho); one fit for all."""
    draws = spark.range(1, B_NULL + 1).select(F.col("id").alias("draw")).crossJoin(F.broadcast(rho))
    cell = F.concat_ws("|", *[F.col(c).cast("string") for c in (*scenario, "draw")])
    series = calibration.ar1_series(draws, FIRST, LAST, "null").withColumn("cell", cell)
    stats = hinge_fits(series.select("cell", "t", "v"), FIRST, LAST).select("cell", F.col("supf").alias("stat"))
    parts = F.split("cell", r"\|")
    return stats.select(*[parts[i].alias(c) for i, c in enumerate(scenario)], parts[len(scenario)].cast("long").alias("draw"), "stat")


def null(spark: SparkSession, d: str) -> DataFrame:
    return null_stats(spark, corrected(spark, d).select(F.col("corrected").alias("rho")))


@query("stat17_null_table", f"with {CHAIN} select cell draw, round(stat, 4) stat from nul")
def null_table(spark, d):
    """The null at the cells' own autocorrelation: a table of draws."""
    return null(spark, d).select("draw", F.round("stat", 4).alias("stat"))


@query("stat19_null_summary", f"with {CHAIN} select round(quantile_disc(stat, 0.90), 4) c90, round(quantile_disc(stat, 0.95), 4) c95, round(quantile_disc(stat, 0.99), 4) c99, round(avg(stat), 4) mean, round(median(stat), 4) median, count(*) n, count(*) filter (where isinf(stat)) n_inf from nul")
def null_summary(spark, d):
    disc = lambda p, a: F.round(F.expr(f"percentile_disc({p}) within group (order by stat)"), 4).alias(a)  # noqa: E731  the draws of one null
    return null(spark, d).agg(disc(0.90, "c90"), disc(0.95, "c95"), disc(0.99, "c99"), F.round(F.avg("stat"), 4).alias("mean"), F.round(F.median("stat"), 4).alias("median"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("stat") == float("inf")).alias("n_inf"))


def tested(spark: SparkSession, d: str) -> DataFrame:
    """cell, tau, supf, status, direction_ok, k, p of every cell with a full series."""
    fits = cut(hinge_fits(yearly(spark, d), FIRST, LAST))
    p = exceedance(fits.select("cell", F.col("supf").alias("stat")), null(spark, d), B_NULL)
    return fits.select("cell", "tau", "supf", "status", "direction_ok").join(p.select("cell", "k", "p"), "cell")


TESTED = f"{CHAIN}, obs as (select cell, tau, supf, sb < -1e-12 and sb+step > 1e-12 ok, (select count(*) from nul where stat >= supf) k from fin)"


@query("stat18_calibrated_p", f"with {TESTED} select cell, tau, k, round((1 + k)/{B_NULL + 1}e0, 6) p, 'normal' status from obs")
def calibrated_p(spark, d):
    return tested(spark, d).select("cell", "tau", "k", F.round("p", 6).alias("p"), "status")


QS = f"{TESTED}, lv as (select k, count(*) n, (1 + k)/{B_NULL + 1}e0 p from obs group by 1), qr as (select *, p*sum(n) over ()/sum(n) over (order by k)::double raw, sum(n) over () m from lv), ql as (select k, least(1, min(raw) over (order by k desc)) q_bh, least(1, min(raw) over (order by k desc)*list_sum(list_transform(range(1, m::bigint + 1), lambda i: 1.0::double/i))) q_by from qr)"


@query("stat10_break_q", f"with {QS} select cell, tau, round(q_bh, 6) q_bh, round(q_by, 6) q_by, q_bh < 0.05 and ok recovery from obs join ql using (k)")
def break_q(spark, d):
    """Cells whose break turns a fall into a rise and passes the discrete FDR of the calibrated p."""
    t = cut(tested(spark, d))
    q = fdr.discrete(t.groupBy("k").agg(F.count(F.lit(1)).alias("n")), B_NULL)
    return t.join(F.broadcast(q.select("k", "q_bh", "q_by")), "k").select("cell", "tau", F.round("q_bh", 6).alias("q_bh"), F.round("q_by", 6).alias("q_by"), ((F.col("q_bh") < 0.05) & F.col("direction_ok")).alias("recovery"))


@query("agg34_calibrated_histogram", f"with {TESTED} select k, count(*) n from obs group by 1")
def calibrated_histogram(spark, d):
    return tested(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_rhos = "(select 'zero' g, 0e0 rho union all select 'raw', raw from fixed union all select 'corrected', rho from fixed)"
SENS = f"""{CHAIN.split(', null_series as')[0].replace("(select 1 g, rho from fixed)", _rhos)}, null_series as (select g||'|'||b cell, t, v from null_ar), {_nf},
ob as (select g, cell, count(*) filter (where stat >= supf) k from (select distinct g from null_ar), fin, (select split_part(cell, '|', 1) ng, stat from nul) where ng = g group by 1, 2),
lv as (select g, k, count(*) n, (1 + k)/{B_NULL + 1}e0 p from ob group by 1, 2), qr as (select *, p*sum(n) over (partition by g)/sum(n) over (partition by g order by k)::double raw, sum(n) over (partition by g) m from lv),
ql as (select g, k, n, min(raw) over (partition by g order by k desc) q, list_sum(list_transform(range(1, m::bigint + 1), lambda i: 1.0::double/i)) h from qr)"""


@query("stat22_rho_sensitivity", f"with {SENS} select g scenario, sum(n)::bigint n_cells, coalesce(sum(n) filter (where q < 0.05), 0)::bigint n_bh, coalesce(sum(n) filter (where q*h < 0.05), 0)::bigint n_by from ql group by 1")
def rho_sensitivity(spark, d):
    """Breaks found with no, the raw and the corrected autocorrelation in the null, under both step-up rules."""
    one = corrected(spark, d)
    rhos = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), c.alias("rho")) for n, c in (("zero", F.lit(0.0)), ("raw", F.col("rho")), ("corrected", F.col("corrected")))])).alias("x")).select("x.scenario", "x.rho")
    fits = hinge_fits(yearly(spark, d), FIRST, LAST).select("cell", F.col("supf").alias("stat"))
    asked = cut(fits.crossJoin(F.broadcast(rhos.select("scenario"))))
    out = ranges.count_at_least(asked, null_stats(spark, rhos, ["scenario"]), by=["scenario"]).withColumn("p", (1 + F.col("k")) / float(B_NULL + 1))
    q = fdr.adjust(out.select("scenario", "cell", "p"), ["scenario"])
    return q.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("q_bh") < 0.05).alias("n_bh"), F.count_if(F.col("q_by") < 0.05).alias("n_by"))


#: Cells with a planted trend, areas in lines, five zones; the trend is by adjusted q, as the class rule has it.
LINES = "series as (select (l_suppkey % 60)::int cell, (l_orderkey % 20 + 1)::int t, round(avg(l_quantity) + case (l_suppkey % 60) % 4 when 0 then 0.3*(l_orderkey % 20 + 1) when 1 then -0.25*(l_orderkey % 20 + 1) else 0 end, 6)::double v, count(*) n from lineitem group by l_suppkey % 60, l_orderkey % 20 + 1)"
HIGH, ALPHA = 0.9, 0.05
_c6 = ", ".join(f"case when rf >= {HIGH} then 'H' else 'L' end || case when q_{m} < {ALPHA} and sen_slope > 0 then '+' when q_{m} < {ALPHA} and sen_slope < 0 then '-' else '0' end class_{m}" for m in ("bh", "by", "bky"))
C6Q = f"""{ADJ.replace(SERIES, LINES)}, q95 as (select cell % 5 zone, quantile_cont(v, 0.95) q from series group by 1), late as (select cell, avg(v) l from series where t > 15 group by 1 having count(v) >= 4),
rf as (select cell, cell % 5 zone, case when q > 1e-6 then l/q end rf from late join q95 on zone = cell % 5), c6 as (select rf.cell, zone, {_c6} from rf join adj using (cell) where rf is not null and q_bh is not null)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity")
    g = li.groupBy((F.col("l_suppkey") % 60).cast("int").alias("cell"), (F.col("l_orderkey") % 20 + 1).cast("int").alias("t")).agg(F.avg("l_quantity").alias("v"), F.count(F.lit(1)).alias("n"))
    planted = F.when(F.col("cell") % 4 == 0, 0.3 * F.col("t")).when(F.col("cell") % 4 == 1, -0.25 * F.col("t")).otherwise(0.0)
    return g.withColumn("v", F.round(F.col("v") + planted, 6))


def classes_by_q(spark: SparkSession, d: str) -> DataFrame:
    """cell, zone and the class by each of the three adjusted q; cells without a ratio or a q have no class."""
    s = cut(lines(spark, d))
    t = fdr.adjust(trend.with_trend(pack(complete(s))).select("cell", "sen_slope", "p").withColumn("family", F.lit(1)), ["family"])
    zone = (F.col("cell") % 5).alias("zone")
    q95 = ranges.quantiles(s.select(zone, "v"), "v", [0.95], ["zone"]).select("zone", "q")
    late = s.filter("t > 15").groupBy("cell").agg(F.avg("v").alias("l"), F.count("v").alias("c")).filter("c >= 4").select("cell", zone, "l")
    rf = late.join(F.broadcast(q95), "zone").select("cell", "zone", ratio(F.col("l"), F.col("q")).alias("rf"))
    high = F.when(F.col("rf") >= HIGH, "H").otherwise("L")
    sign = lambda m: F.when((F.col(f"q_{m}") < ALPHA) & (F.col("sen_slope") > 0), "+").when((F.col(f"q_{m}") < ALPHA) & (F.col("sen_slope") < 0), "-").otherwise("0")
    return rf.join(t, "cell").filter("rf is not null and q_bh is not null").select("cell", "zone", *[F.concat(high, sign(m)).alias(f"class_{m}") for m in ("bh", "by", "bky")])


@query("flt11_class6_q", f"with {C6Q} select * from c6")
def class6_q(spark, d):
    return classes_by_q(spark, d)


@query("flt12_trend_state", f"with {ADJ.replace(SERIES, LINES)} select cell, round(q_bh, 6) q, case when q_bh < {ALPHA} and sen_slope > 0 then 'T+' when q_bh < {ALPHA} and sen_slope < 0 then 'T-' when q_bh is not null then 'T0' end trend_state from adj")
def trend_state(spark, d):
    from veldt.queries.trend import state

    t = fdr.adjust(trend.with_trend(pack(complete(lines(spark, d)))).select("cell", "sen_slope", "p").withColumn("family", F.lit(1)), ["family"])
    return t.select("cell", F.round("q_bh", 6).alias("q"), state(F.col("sen_slope"), F.col("q_bh"), ALPHA).alias("trend_state"))


_six = "(select unnest(['H+','H0','H-','L+','L0','L-']) class6)"


@query("agg06_class_area_q", f"""with {C6Q}, area as (select cell, sum(n)::double a from series group by 1), g as (select coalesce(zone::varchar, 'Overall') as zone, class_bh class6, sum(a) area, count(*) n from c6 join area using (cell) group by grouping sets ((zone, class_bh), (class_bh))),
dim as (select * from (select unnest(['0', '1', '2', '3', '4', 'Overall']) as zone), {_six})
select dim.zone, dim.class6, coalesce(area, 0) area, coalesce(n, 0) n, round(coalesce(area, 0)/nullif(sum(coalesce(area, 0)) over (partition by dim.zone), 0), 6) prop from dim left join g on g.zone = dim.zone and g.class6 = dim.class6""")
def class_area_q(spark, d):
    """Areas and shares of all classes by zone and overall, absent ones as zero."""
    from pyspark.sql import Window

    area = lines(spark, d).groupBy("cell").agg(F.sum("n").cast("double").alias("a"))
    c = classes_by_q(spark, d).select("cell", F.col("zone").cast("string").alias("zone"), F.col("class_bh").alias("class6")).join(area, "cell")
    g = c.groupingSets([["zone", "class6"], ["class6"]], "zone", "class6").agg(F.sum("a").alias("area"), F.count(F.lit(1)).alias("n")).withColumn("zone", F.coalesce("zone", F.lit("Overall")))
    dim = spark.range(1).select(F.explode(F.array(*[F.lit(str(z)) for z in range(5)], F.lit("Overall"))).alias("zone")).select("zone", F.explode(F.array(*map(F.lit, ALL6))).alias("class6"))
    full = F.broadcast(dim).join(g, ["zone", "class6"], "left").select("zone", "class6", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("n", F.lit(0)).alias("n"))
    whole = F.sum("area").over(Window.partitionBy("zone"))
    return full.select("zone", "class6", "area", "n", F.round(F.when(whole != 0, F.col("area") / whole), 6).alias("prop"))
