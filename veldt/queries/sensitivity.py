"""Profiles, sensitivities and hold-outs of a quantile forest, fair ranks, the gate on rho, acceptance of published classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import fdr, forest, ranges, sensitivity
from veldt.operators.breaks import hinge_fits
from veldt.queries import query
from veldt.queries.breaks import FIRST, LAST, yearly
from veldt.queries.chain import B_NULL, SENS, corrected, null_stats
from veldt.sources.shared import cut
from veldt.sources.tables import table

#: Trees of the fixed forest, quantiles, ages of the profile and of the scenarios, the reference age, thresholds.
TREES = 5
SHARES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
AGES, SCENES, REF, LIMITS = [2, 8, 16, 24, 32, 40, 48], [16, 24, 40], 24, [30.0, 40.0, 45.0, 51.0]
LAYERS = ["mean", *SHARES]
_leaf = "(floor(least(age, 44)/(5 + t))*10000 + floor(b/(2 + t % 3))*100 + floor(c/(3 + t % 2)))::bigint"
_li = "li as (select l_orderkey k, l_linenumber n, l_quantity age, round(l_discount*100)::bigint b, round(l_tax*100)::bigint c, floor(l_extendedprice/5000) y from lineitem)"
_fc = ", ".join(f"min(y) filter (where upto >= total*{s} - 1e-9) {n}" for n, s in SHARES.items())


def leaf() -> list:
    """tree and leaf columns of rows with age, b, c: trees by rule; beyond an age of 44 leaves are open."""
    t = F.col("tree")
    cells = (F.floor(F.least(F.col("age"), F.lit(44.0)) / (5 + t)) * 10000 + F.floor(F.col("b") / (2 + t % 3)) * 100 + F.floor(F.col("c") / (3 + t % 2))).cast("long")
    return [t, cells.alias("leaf")]


def planted(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """k, n, age (quantity), b, c, y (price in steps) of every line."""
    pct = lambda c: F.round(F.col(c) * 100).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("age"), pct("l_discount").alias("b"), pct("l_tax").alias("c"), F.floor(F.col("l_extendedprice") / 5000).cast("double").alias("y"))


def at_ages(spark: SparkSession, d: str, ages: list[float]) -> DataFrame:
    """id, b, c, age, mean and quantiles: forecasts for every kind of line at each age, from all lines."""
    li = lines(spark, d)
    kinds = li.groupBy("b", "c").agg(F.count(F.lit(1)).alias("lines")).withColumn("id", F.col("b") * 1000 + F.col("c"))
    rows = sensitivity.over_grid(kinds, "age", ages).withColumn("key", F.concat_ws("_", "id", "age"))
    train = planted(li).select(*leaf(), "y")
    found = forest.quantiles(train, planted(rows).select("key", *leaf()), ["key"], "y", SHARES)
    return rows.join(found, "key").drop("key")


def _at_sql(ages: list[float]) -> str:
    return f"""{_li}, ki as (select b, c, b*1000 + c id, age::double age from (select distinct b, c from li), (select unnest({ages}) age)), tr as (select t, {_leaf} leaf, y from li, range({TREES}) r(t)),
lv as (select t, leaf, y, count(*)/any_value(m)::double w from tr join (select t, leaf, count(*) m from tr group by 1, 2) using (t, leaf) group by 1, 2, 3), rw as (select id, age, t, {_leaf} leaf from ki, range({TREES}) r(t)),
sp as (select id, age, y, sum(w) w from rw join lv using (t, leaf) group by 1, 2, 3), up as (select *, sum(w) over (partition by id, age) total, sum(w) over (partition by id, age order by y) upto from sp),
fc as (select id, age, sum(w*y)/any_value(total) mean, {_fc} from up group by 1, 2)"""


@query("ml16_age_profile", f"with {_at_sql(AGES)}, lg as ({' union all '.join(f'select age, {chr(39)}{c}{chr(39)} layer, {c} v from fc' for c in LAYERS)}) select age, layer, count(v) n, round(avg(v), 6) mean, round(median(v), 6) median, round(quantile_cont(v, 0.05), 6) q05, round(quantile_cont(v, 0.95), 6) q95, round(min(v), 6) least, round(max(v), 6) greatest from lg group by 1, 2")
def age_profile(spark, d):
    """What the forest forecasts at seven ages with the other predictors as they are."""
    p = sensitivity.profile(at_ages(spark, d, AGES), "age", LAYERS)
    return p.select("age", "layer", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "q05", "q95", "least", "greatest")])


@query("ml17_age_sensitivity", f"with {_at_sql(SCENES)} select a.id, a.age, {', '.join(f'round(a.{c} - r.{c}, 6) {c}_change, round(case when abs(r.{c}) > 1e-6 then 100*(a.{c} - r.{c})/r.{c} end, 6) {c}_percent' for c in LAYERS)} from fc a left join fc r on r.id = a.id and r.age = {REF} where a.age <> {REF}")
def age_sensitivity(spark, d):
    """Change of the forecasts of every kind of line from the reference age, and in percent."""
    s = sensitivity.against_reference(at_ages(spark, d, SCENES), ["id"], "age", REF, LAYERS)
    return s.select("id", "age", *[F.round(f"{c}_{k}", 6).alias(f"{c}_{k}") for c in LAYERS for k in ("change", "percent")])


_held = f"""{_li}, th as (select t0 threshold, count(*) filter (where age >= t0) n_held, count(*) filter (where age < t0) n_train, max(age) filter (where age < t0) train_max from li, (select unnest({LIMITS})::double t0) group by 1),
st as (select *, case when n_held >= 20 and n_train >= 100 then 'ok' else 'too few' end status from th),
tr as (select threshold, t, {_leaf} leaf, y from li join st on status = 'ok' and age < threshold, range({TREES}) r(t)),
lv as (select threshold, t, leaf, y, count(*)/any_value(m)::double w from tr join (select threshold, t, leaf, count(*) m from tr group by 1, 2, 3) using (threshold, t, leaf) group by 1, 2, 3, 4),
te as (select threshold, mode, case when mode = 'clamped' then least(age, train_max) else age end age, b, c, y from li join st on status = 'ok' and age >= threshold, (values ('clamped'), ('uncapped')) m(mode)),
ki as (select distinct threshold, mode, age, b, c from te), rw as (select threshold, mode, age, b, c, t, {_leaf} leaf from ki, range({TREES}) r(t)),
sp as (select threshold, mode, rw.age, rw.b, rw.c, lv.y, sum(w) w from rw join lv using (threshold, t, leaf) group by all), up as (select *, sum(w) over (partition by threshold, mode, age, b, c) total, sum(w) over (partition by threshold, mode, age, b, c order by y) upto from sp),
fc as (select threshold, mode, age, b, c, {_fc} from up group by all), ev as (select te.*, q05, q50, q95 from te join fc using (threshold, mode, age, b, c)),
lg as ({' union all '.join(f'select threshold, mode, {s}::double quantile, y, {n} q from ev' for n, s in SHARES.items())}),
cv as (select threshold, mode, quantile, count(q) n, avg((y <= q)::int) coverage, avg((y <= q)::int) - any_value(quantile) gap, avg(case when y >= q then quantile*(y - q) else (quantile - 1)*(y - q) end) pinball, avg(q - y) bias, 100*avg((y > q)::int) above from lg group by 1, 2, 3)"""


def hold_outs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(limits, coverage) of the forest beyond each threshold; all hold-outs are one job, their trees told apart by threshold."""
    li = lines(spark, d)
    found = cut(sensitivity.limits(li, "age", LIMITS))
    train, test = sensitivity.held_out(li, "age", found)
    grown = F.concat_ws("|", "threshold", "tree").alias("tree")
    key = F.concat_ws("|", "threshold", "mode", "age", "b", "c").alias("key")
    test = test.withColumn("key", key)
    kinds = planted(test.select("key", "threshold", "age", "b", "c").distinct()).select("key", grown, leaf()[1])
    told = forest.quantiles(planted(train).select(grown, leaf()[1], "y"), kinds, ["key"], "y", SHARES)
    return found, sensitivity.coverage(test.join(told, "key"), ["threshold", "mode"], "y", SHARES)


@query("ml18_holdout_coverage", f"with {_held} select st.threshold, n_held, n_train, train_max, status, mode, quantile, n, round(coverage, 6) coverage, round(gap, 6) gap, round(pinball, 6) pinball, round(bias, 6) bias, round(above, 6) above from st left join cv using (threshold)")
def holdout_coverage(spark, d):
    """Coverage beyond four thresholds, clamped and uncapped; a threshold with too few rows keeps its row, without figures."""
    found, c = hold_outs(spark, d)
    return found.join(c, "threshold", "left").select("threshold", "n_held", "n_train", "train_max", "status", "mode", "quantile", "n", *[F.round(x, 6).alias(x) for x in ("coverage", "gap", "pinball", "bias", "above")])


@query("ml18_verdict", f"with {_held}, s as (select *, row_number() over (order by threshold desc) r from cv where mode = 'clamped' and quantile = 0.95) select threshold, round(coverage, 6) coverage, round(above, 6) above, case when 4*(select max(age) from li) < 120 then 'not reached' when coverage < 0.85 and above > 10 then 'unreliable, a lower bound' when coverage < 0.9 then 'within the area of applicability only' else 'credible' end verdict from s where r = 1")
def holdout_verdict(spark, d):
    """What the strictest hold-out says; an age here stands for four years."""
    _, c = hold_outs(spark, d)
    last = c.filter("mode = 'clamped' and quantile = 0.95").orderBy(F.desc("threshold")).limit(1)
    top = lines(spark, d).agg((4 * F.max("age")).alias("largest"))
    return last.join(F.broadcast(top)).select("threshold", F.round("coverage", 6).alias("coverage"), F.round("above", 6).alias("above"), sensitivity.verdict(F.col("largest"), F.col("coverage"), F.col("above")).alias("verdict"))


@query("ml12_fair_ranking", """with r as (select l_suppkey % 12 setting, l_returnflag response, avg(abs(l_quantity - 25)) score from lineitem where not (l_suppkey % 12 = 4 and l_returnflag = 'R') and not (l_suppkey % 12 = 7 and l_returnflag <> 'N') group by 1, 2),
g as (select setting, avg(score) score, count(distinct response) n_responses from r group by 1), c as (select *, n_responses = (select count(distinct response) from r) complete from g)
select setting, round(score, 6) score, n_responses, complete, case when complete or not (select bool_or(complete) from c) then row_number() over (partition by complete order by score, setting) end place from c""")
def fair_ranking(spark, d):
    """Settings by their mean score over all responses; those not tried for each are out."""
    p, f = F.col("l_suppkey") % 12, F.col("l_returnflag")
    li = table(spark, d, "lineitem").filter(~((p == 4) & (f == "R")) & ~((p == 7) & (f != "N")))
    ranked = li.groupBy(p.alias("setting"), f.alias("response")).agg(F.avg(F.abs(F.col("l_quantity") - 25)).alias("score"))
    return sensitivity.fair_ranking(ranked, "response", "setting", "score").select("setting", F.round("score", 6).alias("score"), "n_responses", "complete", "place")


def gate_tests(spark: SparkSession, d: str) -> DataFrame:
    """scenario, response, cell, tau, direction_ok, p, q_bh, rho under the corrected and the raw autocorrelation."""
    one = corrected(spark, d)
    rhos = cut(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(c).alias("rho")) for n, c in (("raw", "rho"), ("corrected", "corrected"))])).alias("x")).select("x.scenario", "x.rho"))
    fits = cut(hinge_fits(yearly(spark, d), FIRST, LAST))
    asked = cut(fits.select("cell", F.col("supf").alias("stat"), "tau", "direction_ok").crossJoin(F.broadcast(rhos)))
    k = ranges.count_at_least(asked, null_stats(spark, rhos, ["scenario"]), by=["scenario"])
    t = cut(k.select("scenario", "rho", "cell", (F.col("cell") % 3).alias("response"), "tau", "direction_ok", ((1 + F.col("k")) / float(B_NULL + 1)).alias("p")))
    return fdr.adjust(t, ["scenario"])


_gate = f"""with {SENS}, te as (select ob.g, f.cell % 3 response, f.tau, (1 + ob.k)/{B_NULL + 1}e0 p, q < 0.05 sig, q < 0.05 and sb < -1e-12 and sb + step > 1e-12 rec from ob join ql on ql.g = ob.g and ql.k = ob.k join fin f on f.cell = ob.cell where ob.g <> 'zero'),
yr as (select g, response, arg_max(tau, n*1000 - tau) modal_year from (select g, response, tau, count(*) n from te where rec group by 1, 2, 3) group by 1, 2), ct as (select g, max(p) filter (where sig) cutoff from te group by 1),
sm as (select te.g, te.response, count(*) filter (where rec) breaks, any_value(modal_year) modal_year, any_value(cutoff) cutoff from te left join yr using (g, response) join ct on ct.g = te.g group by 1, 2),
x as (select p.response, case when p.breaks > 0 then s.breaks/p.breaks::double end retention, s.cutoff/{1 / (B_NULL + 1)!r} floor_ratio, s.modal_year - p.modal_year year_shift, p.breaks pb from sm p join sm s on p.g = 'corrected' and s.g = 'raw' and p.response = s.response),
c as (select *, case when pb = 0 then 'PRIMARY_ZERO_RECOVERY' when retention >= 0.5 then 'ROBUST' when retention >= 0.1 then 'SENSITIVE' else 'COLLAPSE' end retention_class from x)
select response, round(retention, 6) retention, round(floor_ratio, 6) floor_ratio, year_shift, retention_class, case when floor_ratio is null then 'NO_FDR_CUTOFF' when floor_ratio >= 10 then 'CLEAR_OF_MC_FLOOR' else 'NEAR_MC_FLOOR' end floor_class, case when year_shift is null then 'NOT_EVALUABLE' when abs(year_shift) <= 1 then 'MODAL_YEAR_STABLE' else 'MODAL_YEAR_SHIFT' end year_class,
case when retention_class in ('ROBUST', 'PRIMARY_ZERO_RECOVERY') then 'GO' else 'CONDITIONAL_GO' end row_gate, case when bool_and(retention_class in ('ROBUST', 'PRIMARY_ZERO_RECOVERY')) over () then 'GO' else 'CONDITIONAL_GO' end overall,
case when bool_or(retention_class = 'COLLAPSE') over () then 'SEVERE_RHO_MODEL_SENSITIVITY' when bool_or(retention_class = 'SENSITIVE') over () then 'MATERIAL_RHO_MODEL_SENSITIVITY' else 'RHO_STRESS_ROBUST' end severity from c"""


@query("stat26_rho_gate", _gate)
def rho_gate(spark, d):
    """Breaks that stay when the raw autocorrelation takes the corrected one's place, for three groups of cells, and what follows."""
    t = cut(gate_tests(spark, d).withColumn("sig", F.col("q_bh") < 0.05).withColumn("rec", F.col("sig") & F.col("direction_ok")))
    modal = t.filter("rec").groupBy("scenario", "response", "tau").agg(F.count(F.lit(1)).alias("n")).groupBy("scenario", "response").agg(F.max_by("tau", F.struct("n", -F.col("tau"))).alias("modal_year"))
    cutoff = t.groupBy("scenario").agg(F.max(F.when(F.col("sig"), F.col("p"))).alias("cutoff"))
    s = t.groupBy("scenario", "response").agg(F.count_if("rec").alias("breaks"), F.first("rho").alias("rho")).join(modal, ["scenario", "response"], "left").join(F.broadcast(cutoff), "scenario").withColumn("least_p", F.lit(1.0 / (B_NULL + 1)))
    s = cut(s)
    g = sensitivity.rho_gate(s.filter("scenario = 'corrected'"), s.filter("scenario = 'raw'"))
    return g.withColumn("retention", F.round("retention", 6)).withColumn("floor_ratio", F.round("floor_ratio", 6))


#: Codes of the classes.
CODES = {"H+": 1, "H0": 2, "H-": 3, "L+": 4, "L0": 5, "L-": 6}
_case = "case class6 " + " ".join(f"when '{k}' then {v}" for k, v in CODES.items()) + " end"


@query("val03_acceptance", f"""with ce as (select c_custkey cell, (c_nationkey % 5)::varchar as zone, (['H+','H0','H-','L+','L0','L-'])[c_custkey*7 % 11 + 1] class6, (1 + c_custkey % 7)::double area from customer),
ra as (select cell, case when cell % 61 = 0 then 9 when cell % 47 = 0 then null else {_case} end code from ce where cell % 53 <> 0), cn as (select coalesce(zone, 'Overall') as zone, class6, count(*) k, sum(area) a from ce where class6 is not null group by grouping sets ((zone, class6), (class6))),
su as (select zone, class6, k + (zone = '2' and class6 = 'L0')::int n, a area from cn where not (zone = '3' and class6 = 'H-') union all select zone, class6, k, a from cn where zone = '4' and class6 = 'H+'),
dim as (select * from (select unnest(['0', '1', '2', '3', '4', 'Overall']) as zone), (select unnest(['H+','H0','H-','L+','L0','L-']) class6)), su1 as (select zone, class6, count(*) times, max(n) n, max(area) area from su group by 1, 2),
f as (select 'unknown code' fault, count(*) n from ra where code not between 1 and 6 union all select 'cell outside the raster', count(*) from ce where cell % 53 = 0 union all select 'class and code differ', count(*) from ce join ra using (cell) where {_case} is distinct from code
union all select 'summary row missing or repeated', count(*) from dim left join su1 using (zone, class6) where times is distinct from 1 union all select 'summary and cells differ', count(*) from su1 left join cn using (zone, class6) where times = 1 and (su1.n <> coalesce(k, 0) or abs(area - coalesce(a, 0)) > 1e-7))
select fault, n, case when n = 0 then 'PASS' else 'FAIL' end status from f""")
def class_acceptance(spark, d):
    """Cell table, raster and summary of classes over customers, with planted faults, held against each other."""
    k = F.col("c_custkey")
    named = F.get(F.array(*map(F.lit, CODES)), (k * 7 % 11).cast("int"))
    cells = table(spark, d, "customer").select(k.alias("cell"), (F.col("c_nationkey") % 5).cast("string").alias("zone"), named.alias("class6"), (1 + k % 7).cast("double").alias("area"))
    code = F.coalesce(*[F.when(F.col("class6") == n, v) for n, v in CODES.items()])
    c = F.col("cell")
    raster = cells.filter(c % 53 != 0).select("cell", F.when(c % 61 == 0, 9).when(c % 47 == 0, F.lit(None)).otherwise(code).alias("code"))
    count = cells.filter("class6 is not null").groupingSets([["zone", "class6"], ["class6"]], "zone", "class6").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")).withColumn("zone", F.coalesce("zone", F.lit("Overall")))
    at = lambda z, n: (F.col("zone") == z) & (F.col("class6") == n)
    summary = count.filter(~at("3", "H-")).withColumn("n", F.col("n") + at("2", "L0").cast("int")).union(count.filter(at("4", "H+")))
    return sensitivity.acceptance(cells, raster, summary, CODES, [str(z) for z in range(5)])
