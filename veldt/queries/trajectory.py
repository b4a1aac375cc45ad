"""Regional trajectories: one mean series a region, its break against a null of its own autocorrelation, and a bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import calibration
from veldt.operators.breaks import hinge_fits, hinge_residuals
from veldt.operators.ranges import count_at_least
from veldt.queries import query
from veldt.queries.breaks import FIRST, FITS, LAST, YEARLY
from veldt.queries.chain import B_BIAS, BIAS, GRID_RHO, MOST, STEPS, _ar1_sql, _lag1_sql, _noise_sql, bias_table
from veldt.sources.shared import cut
from veldt.sources.tables import table

#: Draws of a region's null, replicates of the bootstrap, least replicates for an interval, level, coverage that is enough.
B_NULL, B_BOOT, LEAST_BOOT, ALPHA, COVERED = 99, 49, 20, 0.05, 0.95
REGIONS = "regional as (select (l_suppkey % 6)::int cell, (l_orderkey % 20 + 1)::int t, round(avg(l_quantity) + case when (l_suppkey % 6) % 2 = 0 then -0.4*(l_orderkey % 20 + 1) + 1.1*greatest(l_orderkey % 20 + 1 - 9, 0) else 0 end, 6)::double v, count(*)::double area from lineitem group by l_suppkey % 6, l_orderkey % 20 + 1)"


def regional(spark: SparkSession, d: str) -> DataFrame:
    """cell (region), t, v, area: the mean of a region's lines by step, with a hinge planted on every other region."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity")
    g = li.groupBy((F.col("l_suppkey") % 6).cast("int").alias("cell"), (F.col("l_orderkey") % 20 + 1).cast("int").alias("t")).agg(F.avg("l_quantity").alias("v"), F.count(F.lit(1)).cast("double").alias("area"))
    planted = F.when(F.col("cell") % 2 == 0, -0.4 * F.col("t") + 1.1 * F.greatest(F.col("t") - 9, F.lit(0))).otherwise(0.0)
    return g.withColumn("v", F.round(F.col("v") + planted, 6))


_HINGES = FITS.split("yrs as", 1)[1].split("fit as", 1)[0].rstrip().rstrip(",")


def _fits_sql(name: str, series: str) -> str:
    """name (cell, tau, supf, step, sb): the best hinge of each cell of series, from hp and hh."""
    return f"""{name}_b as (select cell, regr_slope(v, t) b, greatest(0, regr_syy(v,t) - regr_sxy(v,t)^2/regr_sxx(v,t)) sse0 from {series} group by 1 having count(*) = {STEPS}),
{name}_f as (select cell, tau, sum(v*h) yh from {series} join hp on y = t group by 1, 2),
{name}_s as (select f.cell, f.tau, sse0, greatest(0, sse0 - yh*yh/hh) sse1, yh/hh step, b - yh/hh*s sb from {name}_f f join hh on hh.tau = f.tau join {name}_b q on q.cell = f.cell),
{name} as (select cell, tau, {STEPS - 3}*(sse0 - sse1)/sse1 supf, step, sb from {name}_s qualify row_number() over (partition by cell order by sse1, tau) = 1)"""


def _resid_sql(name: str, series: str, fits: str) -> str:
    return f"{name} as (select s.cell, s.t, s.v, s.v - regr_intercept(s.v, s.t) over (partition by s.cell) - regr_slope(s.v, s.t) over (partition by s.cell)*s.t - step*h resid from {series} s join {fits} f on f.cell = s.cell join hp on hp.tau = f.tau and hp.y = s.t)"


def _lag_sql(name: str, resid: str, by: str = "cell") -> str:
    return f"{name} as (select {by}, sum(e*f)/sqrt(sum(e*e) filter (where f is not null)*sum(f*f)) rho from (select {by}, resid e, lead(resid) over (partition by {by} order by t) f from {resid}) group by {by})"


def _fix_sql(name: str, raw: str, mapping: str) -> str:
    """name (cell, raw, rho): raw (cell, rho) through the inverse of a bias map."""
    return f"""{name}_o as (select iso x, median(true_rho) y from {mapping} group by 1), {name}_k as (select *, lead(x) over (order by x) x1, lead(y) over (order by x) y1 from {name}_o),
{name} as (select cell, rho raw, greatest(-{MOST}, least({MOST}, case when x is null then (select arg_min(y, x) from {name}_k) when x1 is null then y else y + (rho - x)/(x1 - x)*(y1 - y) end)) rho from {raw} left join {name}_k on rho >= x and (x1 is null or rho < x1))"""


_hbias = f"""{_ar1_sql('hknown', 'bias', 'grid_rho')}, hseries as (select g*{B_BIAS + 1} + b cell, any_value(rho) rho, t, any_value(v) v from hknown group by 1, 3), {_fits_sql('hfit', 'hseries')}, {_resid_sql('hres', 'hseries', 'hfit')}, {_lag_sql('hlag', 'hres')},
hmid as (select q.rho true_rho, median(hlag.rho) estimated from hlag join (select distinct cell, rho from hseries) q using (cell) group by 1), hcum as (select *, row_number() over (order by true_rho) i, sum(estimated) over (order by true_rho) cs from hmid),
hstretch as (select a.i a, b.i b, (b.cs - a.cs + a.estimated)/(b.i - a.i + 1) m from hcum a join hcum b on a.i <= b.i), hleast as (select a, b, min(m) over (partition by a order by b desc) m from hstretch),
hbias as (select true_rho, iso from hcum join (select b, max(m) iso from hleast group by 1) on b = i)"""
TRAJ = f"""{REGIONS}, yrs as {_HINGES}, {_fits_sql('rfit', 'regional')}, {_lag1_sql('rlin', 'regional', 'cell')}, {_resid_sql('rres', 'regional', 'rfit')}, {_lag_sql('rhin', 'rres')},
{BIAS}, {_hbias}, {_fix_sql('nrho', 'rlin', 'bias')}, {_fix_sql('brho', 'rhin', 'hbias')},
{_noise_sql('region', B_NULL)}, {_ar1_sql('rnull_ar', 'region', '(select cell g, rho from nrho)')}, rnull_s as (select g*1000 + b cell, t, v from rnull_ar), {_fits_sql('rnull_f', 'rnull_s')}, rnull as (select (cell // 1000)::int region, supf stat from rnull_f),
cover as (select cell, min(area)/max(area) share from regional group by 1), obs as (select f.*, sb < -1e-12 and sb + step > 1e-12 ok, (select count(*) from rnull where region = f.cell and stat >= f.supf) k from rfit f)"""


def fitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(series, fits, residuals, rhos) of the regions; rhos: cell, null_raw, null_rho, boot_raw, boot_rho."""
    s = cut(regional(spark, d))
    fits = cut(hinge_fits(s, FIRST, LAST))
    rest = cut(hinge_residuals(s, fits, FIRST, LAST))
    line = calibration.correct_rho(calibration.lag1_of_residuals(s, ["cell"]), cut(bias_table(spark)), MOST)
    hinge_map = cut(calibration.bias_map(spark, GRID_RHO, B_BIAS, FIRST, LAST, margin=5))
    hinge = calibration.correct_rho(calibration.lag1(rest, ["cell"]), hinge_map, MOST)
    rhos = line.select("cell", F.col("rho").alias("null_raw"), F.col("corrected").alias("null_rho")).join(hinge.select("cell", F.col("rho").alias("boot_raw"), F.col("corrected").alias("boot_rho")), "cell")
    return s, fits, rest, cut(rhos)


def nulls(spark: SparkSession, rhos: DataFrame) -> DataFrame:
    """cell, stat: each region's null at its own rho; all regions' draws are fitted together."""
    draws = spark.range(1, B_NULL + 1).select(F.col("id").alias("draw")).crossJoin(F.broadcast(rhos.select(F.col("cell").alias("region"), F.col("null_rho").alias("rho"))))
    series = calibration.ar1_series(draws, FIRST, LAST, "region").select((F.col("region") * 1000 + F.col("draw")).alias("cell"), "t", "v")
    return hinge_fits(series, FIRST, LAST).select(F.floor(F.col("cell") / 1000).cast("int").alias("cell"), F.col("supf").alias("stat"))


@query("stat25_regional_test", f"with {TRAJ} select obs.cell region, tau, k, round((1 + k)/{B_NULL + 1}e0, 6) p, ok direction_ok, round(n.raw, 6) rho_null_raw, round(n.rho, 6) rho_null, round(b.raw, 6) rho_boot_raw, round(b.rho, 6) rho_boot, round(share, 6) valid_area_min_fraction, share < {COVERED} coverage_warning from obs join nrho n using (cell) join brho b using (cell) join cover using (cell)")
def regional_test(spark, d):
    s, fits, _, rhos = fitted(spark, d)
    cover = s.groupBy("cell").agg((F.min("area") / F.max("area")).alias("share"))
    seen = fits.select("cell", F.col("supf").alias("stat"), "tau", "direction_ok")
    t = count_at_least(seen, nulls(spark, rhos), by=["cell"]).join(rhos, "cell").join(cover, "cell")
    rounded = [F.round(c, 6).alias(n) for c, n in (("null_raw", "rho_null_raw"), ("null_rho", "rho_null"), ("boot_raw", "rho_boot_raw"), ("boot_rho", "rho_boot"), ("share", "valid_area_min_fraction"))]
    return t.select(F.col("cell").alias("region"), "tau", "k", F.round((1 + F.col("k")) / float(B_NULL + 1), 6).alias("p"), "direction_ok", *rounded, (F.col("share") < COVERED).alias("coverage_warning"))


_q = lambda p: f"(list_sort(list(tau) filter (where rec)))[greatest(1, ceil(count(*) filter (where rec)*{p}))::int]"


@query("stat24_trajectory_bootstrap", f"""with {TRAJ}, {_noise_sql('boot', B_BOOT)}, {_ar1_sql('boot_ar', 'boot', '(select cell g, rho from brho)')}, sig as (select cell, sqrt(sum(resid*resid)/{STEPS - 3}) sd from rres group by 1),
boot_s as (select g*1000 + b cell, a.t, r.v - r.resid + sd*a.v v from boot_ar a join rres r on r.cell = a.g and r.t = a.t join sig on sig.cell = a.g), {_fits_sql('boot_f', 'boot_s')},
bo as (select (cell // 1000)::int region, tau, (1 + (select count(*) from rnull where rnull.region = f.cell // 1000 and stat >= f.supf))/{B_NULL + 1}e0 <= {ALPHA} det, sb < -1e-12 and sb + step > 1e-12 ok from boot_f f), br as (select *, det and ok rec from bo)
select region, round(avg(det::int), 6) detection, round(avg(rec::int), 6) recovery, count(*) filter (where rec) n_recovery, case when count(*) filter (where rec) >= {LEAST_BOOT} then {_q(0.025)} end q025, case when count(*) filter (where rec) >= {LEAST_BOOT} then {_q(0.5)} end q50, case when count(*) filter (where rec) >= {LEAST_BOOT} then {_q(0.975)} end q975,
case when count(*) filter (where rec) >= {LEAST_BOOT} then 'ok' else 'unstable' end ci_status from br group by 1""")
def trajectory_bootstrap(spark, d):
    """How often a resampled series of the region's own fit and noise shows the break again, and where."""
    _, _, rest, rhos = fitted(spark, d)
    sd = rest.groupBy("cell").agg(F.sqrt(F.sum(F.col("resid") * F.col("resid")) / (STEPS - 3)).alias("sd"))
    draws = spark.range(1, B_BOOT + 1).select(F.col("id").alias("draw")).crossJoin(F.broadcast(rhos.select(F.col("cell").alias("region"), F.col("boot_rho").alias("rho"))))
    e = calibration.ar1_series(draws, FIRST, LAST, "boot").select("region", "draw", "t", F.col("v").alias("e"))
    base = rest.join(sd, "cell").select(F.col("cell").alias("region"), "t", "fitted", "sd")
    series = e.join(base, ["region", "t"]).select((F.col("region") * 1000 + F.col("draw")).alias("cell"), "t", (F.col("fitted") + F.col("sd") * F.col("e")).alias("v"))
    fits = cut(hinge_fits(series, FIRST, LAST).select(F.floor(F.col("cell") / 1000).cast("int").alias("cell"), F.col("supf").alias("stat"), "tau", "direction_ok"))
    k = count_at_least(fits, nulls(spark, rhos), by=["cell"])
    b = k.withColumn("det", (1 + F.col("k")) / float(B_NULL + 1) <= ALPHA).withColumn("rec", F.col("det") & F.col("direction_ok"))
    n, taus = F.count_if("rec"), F.sort_array(F.collect_list(F.when(F.col("rec"), F.col("tau"))))  # a region's replicates
    q = lambda p: F.when(n >= LEAST_BOOT, F.get(taus, (F.greatest(F.lit(1), F.ceil(n * p)) - 1).cast("int")))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return b.groupBy(F.col("cell").alias("region")).agg(share("det").alias("detection"), share("rec").alias("recovery"), n.alias("n_recovery"), q(0.025).alias("q025"), q(0.5).alias("q50"), q(0.975).alias("q975"), F.when(n >= LEAST_BOOT, "ok").otherwise("unstable").alias("ci_status"))
