"""Tuning, nested validation, cohort tests, contracts of out-of-fold tables, screening and stratified points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.scalars import draw
from veldt.operators import screening, validation
from veldt.queries import query
from veldt.sources.tables import table

#: Outer and inner folds, candidates and the range of their shrinkage.
OUTER, INNER, CANDIDATES, LOW, HIGH = 3, 4, 8, 0.5, 200.0


def _draw(*parts: str) -> str:
    return "('0x'||substr(md5(" + "||'|'||".join(parts) + "), 1, 8))::bigint"


ROWS = f"pl as (select o_orderkey id, o_custkey % 40 g, o_totalprice y, year(o_orderdate)::int yr, {_draw(chr(39) + 'outer' + chr(39), 'o_orderkey')} % {OUTER} \"outer\", {_draw(chr(39) + 'inner' + chr(39), 'o_orderkey')} % {INNER} \"inner\" from orders)"
LHS = f"cd as (select c::int candidate, exp({math.log(LOW)!r} + {math.log(HIGH / LOW)!r}*u) lam from (select c, (row_number() over (order by {_draw(chr(39) + 'lhs' + chr(39), chr(39) + '1' + chr(39), 'c')}, c) - {_draw(chr(39) + 'lhsu' + chr(39), chr(39) + '1' + chr(39), 'c')}/4294967296e0)/{CANDIDATES} u from range(1, {CANDIDATES + 1}) r(c)))"
TUNED = f"""{ROWS}, {LHS}, fo as (select unnest(range({OUTER})) f), io as (select unnest(range({INNER})) i),
tr as (select f, i, g, count(*) n, sum(y) s from pl, fo, io where "outer" <> f and "inner" <> i group by 1, 2, 3), tm as (select f, i, sum(s)/sum(n) m from tr group by 1, 2),
er as (select fo.f, tm.i, candidate, lam, sqrt(avg(power(y - (coalesce(s, 0) + lam*m)/(coalesce(n, 0) + lam), 2))) rmse from pl join fo on "outer" <> f join tm on tm.f = fo.f and tm.i = "inner" left join tr on tr.f = fo.f and tr.i = "inner" and tr.g = pl.g, cd group by fo.f, tm.i, candidate, lam),
sc as (select f fold, candidate, lam, avg(rmse) score from er group by 1, 2, 3), ch as (select *, row_number() over (partition by fold order by score, candidate) = 1 chosen from sc)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    """id, g, y, yr, outer, inner: orders as plots, customers' groups as the predictor, keyed folds."""
    o = table(spark, d, "orders")
    fold = lambda n, k: (draw(n, F.col("o_orderkey").cast("string")) % k).alias(n)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("g"), F.col("o_totalprice").alias("y"), F.year("o_orderdate").alias("yr"), fold("outer", OUTER), fold("inner", INNER))


def candidates(spark: SparkSession) -> DataFrame:
    return validation.latin_hypercube(spark, CANDIDATES, 1, "lhs").select("candidate", validation.log_range(F.col("u1"), LOW, HIGH).alias("lam"))


@query("ml04_inner_tuning", f"with {TUNED} select fold, candidate, round(lam, 6) lam, round(score, 4) score, chosen from ch")
def inner_tuning(spark, d):
    """Candidates of a Latin hypercube by the mean error of the inner folds; the least is chosen for each outer fold."""
    s = validation.inner_scores(validation.fold_sums(rows(spark, d)), candidates(spark))
    return s.select("fold", "candidate", F.round("lam", 6).alias("lam"), F.round("score", 4).alias("score"), "chosen")


OOF = f"""{TUNED}, ot as (select f, g, count(*) n, sum(y) s from pl, fo where "outer" <> f group by 1, 2), om as (select f, sum(s)/sum(n) m from ot group by 1),
oof as (select pl.id, "outer" fold, lam, y observed, (s + lam*m)/(n + lam) prediction from pl join ch on fold = "outer" and chosen join om on om.f = "outer" join ot on ot.f = "outer" and ot.g = pl.g)"""


@query("ml05_nested_oof", f"with {OOF} select id, fold, round(lam, 6) lam, round(prediction, 4) prediction from oof")
def nested_oof(spark, d):
    return validation.out_of_fold(rows(spark, d), ["id"], candidates(spark)).select("id", "fold", F.round("lam", 6).alias("lam"), F.round("prediction", 4).alias("prediction"))


@query("ml05_nested_metrics", f"with {OOF} select fold, count(*) n, round(1 - sum(power(observed - prediction, 2))/(count(*)*var_pop(observed)), 6) r2, round(sqrt(avg(power(observed - prediction, 2))), 4) rmse, round(avg(abs(observed - prediction)), 4) mae from oof group by 1")
def nested_metrics(spark, d):
    m = validation.metrics(validation.out_of_fold(rows(spark, d), ["id"], candidates(spark)), "observed", "prediction", ["fold"])
    return m.select("fold", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


#: Years of the cohorts: fitted on, and tested on.
COHORTS = ((0, 1996), (1998, 9999))


@query("ml06_cohort_test", f"with {ROWS}, tr as (select g, count(*) n, sum(y) s from pl where yr <= {COHORTS[0][1]} group by 1), m as (select sum(s)/sum(n) m from tr), te as (select y, (s + 10*m)/(n + 10) p from pl join tr using (g), m where yr >= {COHORTS[1][0]}) select count(*) n, round(1 - sum(power(y - p, 2))/(count(*)*var_pop(y)), 6) r2, round(sqrt(avg(power(y - p, 2))), 4) rmse, round(avg(abs(y - p)), 4) mae from te")
def cohort_test(spark, d):
    """A fit of the early cohort forecasts the late one; years between belong to neither."""
    r = rows(spark, d)
    early, late = (r.filter(F.col("yr").between(*c)) for c in COHORTS)
    fit = early.groupBy("g").agg(F.count("y").alias("n"), F.sum("y").alias("s"))
    mean = fit.agg((F.sum("s") / F.sum("n")).alias("mean"))
    fit = fit.join(F.broadcast(mean)).select("g", validation.shrunk(F.col("n"), F.col("s"), F.col("mean"), F.lit(10.0)).alias("p"))
    m = validation.metrics(late.join(fit, "g"), "y", "p")
    return m.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("ml07_oof_contract", """with base as (select o_orderkey k, o_orderkey % 5 fold, o_totalprice observed from orders),
o as (select k, sc scenario, case when sc = 'full' and k % 211 = 0 then fold + 1 else fold end fold, case when sc = 'full' and k % 83 = 0 then observed + 1 else observed end observed, case when k % 101 = 0 and sc = 'env' then null else observed*0.9 end prediction, case when k % 151 = 0 then 'qm' else 'raw' end kind
  from base, (select unnest(['env', 'rs', 'full']) sc) where not (sc = 'rs' and k % 97 = 0)),
a as (select * from o union all select * from o where k % 89 = 0 and scenario = 'env'),
c as (select k, count(distinct scenario) have, count(*) - count(distinct scenario) twice, count(*) filter (where prediction is null) bad, count(*) filter (where kind <> 'raw') cal, min(observed) <> max(observed) unlike, min(fold) <> max(fold) folds from a group by 1)
select 'missing scenario' fault, count(*) filter (where have < 3) n from c union all select 'unknown scenario', 0 union all select 'repeated row', count(*) filter (where twice > 0) from c union all select 'not finite', count(*) filter (where bad > 0) from c union all select 'not raw', count(*) filter (where cal > 0) from c union all select 'observations differ', count(*) filter (where unlike) from c union all select 'folds differ', count(*) filter (where folds) from c union all select 'null key', 0""")
def oof_contract(spark, d):
    """Three scenarios of out-of-fold rows with planted faults, counted by the contract."""
    k = F.col("k")
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("fold"), F.col("o_totalprice").alias("observed"), F.explode(F.array(*map(F.lit, ("env", "rs", "full")))).alias("scenario"))
    sc = lambda n: F.col("scenario") == n
    o = base.filter(~(sc("rs") & (k % 97 == 0))).select("k", "scenario", (F.col("fold") + (sc("full") & (k % 211 == 0)).cast("long")).alias("fold"), F.when(sc("full") & (k % 83 == 0), F.col("observed") + 1).otherwise(F.col("observed")).alias("observed"), F.when(sc("env") & (k % 101 == 0), None).otherwise(F.col("observed") * 0.9).alias("prediction"), F.when(k % 151 == 0, "qm").otherwise("raw").alias("kind"))
    return validation.contract_faults(o.union(o.filter(sc("env") & (k % 89 == 0))), "k", ["env", "rs", "full"])


FEATURES = ("price", "price_w3", "price_w7", "quantity", "quantity_30m", "quantity_1km", "tax")
_f = "feats as (select l_orderkey*10 + l_linenumber id, l_extendedprice price, floor(l_extendedprice/3000) price_w3, floor(l_extendedprice/7000) price_w7, l_quantity quantity, floor(l_quantity/3) quantity_30m, floor(l_quantity/10) quantity_1km, l_tax tax, l_discount y from lineitem where l_linenumber <= 7)"
_ranks = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2e0 r_{c}" for c in (*FEATURES, "y"))
RHO = f"{_f}, rk as (select {_ranks} from feats), rho as (" + " union all ".join(f"select '{c}' feature, '{screening.family(c)}' family, abs(corr(r_{c}, r_y)) rho from rk" for c in FEATURES) + ")"


def features(spark: SparkSession, d: str) -> DataFrame:
    """id, the features at their scales and y; repeated lines would share an id and are left to the first."""
    li = table(spark, d, "lineitem").filter("l_linenumber <= 7")
    step = lambda c, n: F.floor(F.col(c) / n).cast("double")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("price"), step("l_extendedprice", 3000).alias("price_w3"), step("l_extendedprice", 7000).alias("price_w7"), F.col("l_quantity").alias("quantity"), step("l_quantity", 3).alias("quantity_30m"), step("l_quantity", 10).alias("quantity_1km"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("y"))


@query("ml01_rank_screen", f"with {RHO} select feature, family, round(rho, 6) rho, row_number() over (partition by family order by rho desc, feature) = 1 scale_kept from rho")
def rank_screen(spark, d):
    """Rank correlation of each feature with the response, and the scale that stays in its family."""
    s = screening.screen(features(spark, d), "id", list(FEATURES), "y")
    return s.select("feature", "family", F.round("rho", 6).alias("rho"), "scale_kept")


_v = ("quantity", "price", "tax")


@query("ml01_inflation", f"with {_f}, r as (select corr(price, quantity) ab, corr(price, tax) ac, corr(quantity, tax) bc from feats), d as (select *, 1 + 2*ab*ac*bc - ab*ab - ac*ac - bc*bc det from r) select 'price' feature, round((1 - bc*bc)/det, 6) vif from d union all select 'quantity', round((1 - ac*ac)/det, 6) from d union all select 'tax', round((1 - ab*ab)/det, 6) from d")
def inflation(spark, d):
    """Variance inflation of three features; a row each."""
    v = screening.inflation(screening.correlations(features(spark, d), list(_v)))
    return spark.createDataFrame(list(zip(_v, map(float, v), strict=True)), "feature string, vif double").withColumn("vif", F.round("vif", 6))


@query("ml13_keyed_choice", "with k as (select p_partkey, p_brand, row_number() over (partition by p_brand order by md5('points|'||p_partkey)) r, count(*) over (partition by p_brand) n from part) select p_partkey, p_brand from k where r <= least(n, 5 + length(p_brand))")
def keyed_choice(spark, d):
    """The same parts of every brand on any number of tasks."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    give = p.groupBy("p_brand").agg(F.least(F.count(F.lit(1)), (5 + F.length("p_brand")).cast("long")).alias("take"))
    return screening.draw_strata(p, "p_brand", "p_partkey", give, "points").select("p_partkey", "p_brand")


@query("ml13_stratified_points")
def stratified_points(spark, d):
    """Two hundred parts spread over eight environments of their size, price and mean line."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).join(li, "p_partkey")
    return screening.stratified_points(p, "p_partkey", ["size", "price", "quantity", "discount"], 200, axes=3, strata=8, least=10)
