"""Calibrated filling with its audit, composites of whole observations, and region codes by several names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import filling
from veldt.queries import query
from veldt.sources.tables import table

_rows = """f as (select l_orderkey k, l_linenumber n, l_suppkey % 7 g, case when l_orderkey % 11 = 0 then null when l_suppkey % 7 = 5 and l_orderkey % 400 <> 1 then null else case when l_suppkey % 7 = 3 then l_tax*100 else l_extendedprice/1000 + l_linenumber*0.5e0 end end y,
case when l_orderkey % 29 = 0 then -9999.0::double else l_extendedprice/1100 + l_tax end x, l_linenumber::double lon, l_quantity lat from lineitem), u as (select *, case when x <> -9999 then x end x1 from f),
p as (select g, count(*) n_pairs, min(y) lo, max(y) hi, avg(y) my, avg(x1) m1, avg(lon) m2, avg(lat) m3, covar_pop(y,x1) y1, covar_pop(y,lon) y2, covar_pop(y,lat) y3, var_pop(y) yy, var_pop(x1) c11, covar_pop(x1,lon) c12, covar_pop(x1,lat) c13, var_pop(lon) c22, covar_pop(lon,lat) c23, var_pop(lat) c33 from u where y is not null and x1 is not null group by 1),
q as (select *, c11*(c22*c33 - c23*c23) - c12*(c12*c33 - c23*c13) + c13*(c12*c23 - c22*c13) det from p),
b as (select *, (y1*(c22*c33 - c23*c23) - y2*(c12*c33 - c13*c23) + y3*(c12*c23 - c13*c22))/det b1, (-y1*(c12*c33 - c23*c13) + y2*(c11*c33 - c13*c13) - y3*(c11*c23 - c12*c13))/det b2, (y1*(c12*c23 - c22*c13) - y2*(c11*c23 - c13*c12) + y3*(c11*c22 - c12*c12))/det b3 from q),
r as (select *, (b1*y1 + b2*y2 + b3*y3)/yy r2 from b), o as (select *, n_pairs >= 30 and r2 >= 0.7 ok from r)"""


def two_sources(spark: SparkSession, d: str) -> DataFrame:
    """k, n, g, y, x, lon, lat of every line: y has gaps, and follows x in most groups; one group has few pairs, one no relation."""
    k, g = F.col("l_orderkey"), F.col("l_suppkey") % 7
    y = F.when(g == 3, F.col("l_tax") * 100).otherwise(F.col("l_extendedprice") / 1000 + F.col("l_linenumber") * 0.5)
    x = F.when(k % 29 == 0, F.lit(-9999.0)).otherwise(F.col("l_extendedprice") / 1100 + F.col("l_tax"))
    return table(spark, d, "lineitem").select(k.alias("k"), F.col("l_linenumber").alias("n"), g.alias("g"), F.when((k % 11 != 0) & ~((g == 5) & (k % 400 != 1)), y).alias("y"), x.alias("x"), F.col("l_linenumber").cast("double").alias("lon"), F.col("l_quantity").alias("lat"))


@query("stat56_calibrated_fill", f"with {_rows} select k, u.n, u.g, round(case when y is not null then y when x1 is null then null when ok then greatest(lo, least(hi, my + b1*(x1 - m1) + b2*(lon - m2) + b3*(lat - m3))) else x1 end, 6) filled, case when y is not null then 'observed' when x1 is null then null when ok then 'calibrated' else 'direct' end method from u left join o using (g)")
def calibrated_fill(spark, d):
    """Gaps filled from the second source, by regression where the group's pairs allow it."""
    out, _ = filling.calibrated_fill(two_sources(spark, d), "y", "x", ("lon", "lat"), ["g"])
    return out.select("k", "n", "g", F.round("filled", 6).alias("filled"), "method")


@query("stat56_fill_audit", f"with {_rows} select u.g, any_value(n_pairs) n_pairs, count(*) filter (where y is null) n_missing, count(*) filter (where y is null and x1 is not null) n_candidates, count(*) filter (where y is null and x1 is not null) n_filled, round(any_value(r2), 6) r2, case when count(*) filter (where y is null and x1 is not null) = 0 then 'none needed' when bool_or(ok) then 'calibrated' when any_value(n_pairs) < 30 then 'direct, too few pairs' else 'direct, low R2' end method from u left join o using (g) group by 1")
def fill_audit(spark, d):
    _, audit = filling.calibrated_fill(two_sources(spark, d), "y", "x", ("lon", "lat"), ["g"])
    return audit.withColumn("r2", F.round("r2", 6))


_obs = "obs as (select l_partkey cell, quarter(l_shipdate)::int season, l_orderkey k, l_linenumber n, l_quantity a, l_discount*100 b, l_tax*100 c, case when l_orderkey % 19 = 0 then null else (l_quantity - l_tax*100)/(l_quantity + l_tax*100 + 1) end ix from lineitem)"


def _composite_sql(share: float, where: str) -> str:
    cols = ", ".join(f"round(median({x}), 4) {x}_median, round(stddev_pop({x}), 4) {x}_sd" for x in "abc")
    return f"select t.*, p.a, p.b, p.c from (select cell, season, round(quantile_cont(ix, {share}), 6) target, {cols} from obs where {where} group by 1, 2) t left join (select o.cell, o.season, a, b, c from obs o join (select cell, season, quantile_cont(ix, {share}) q from obs group by 1, 2) z using (cell, season) where ix is not null and {where} qualify row_number() over (partition by o.cell, o.season order by round(abs(ix - q), 9), k, n) = 1) p using (cell, season)"


@query("agg27_composite", f"with {_obs} select * from ({_composite_sql(0.9, 'season < 4')}) union all by name select * from ({_composite_sql(0.5, 'season = 4')})")
def composites(spark, d):
    """For every part and quarter the line whose index is nearest the quarter's 90 % point, or its median in the last, with medians and deviations."""
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    obs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell"), F.quarter("l_shipdate").cast("int").alias("season"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), q.alias("a"), (F.col("l_discount") * 100).alias("b"), t.alias("c"), F.when(F.col("l_orderkey") % 19 != 0, (q - t) / (q + t + 1)).alias("ix"))
    one = lambda df, share: filling.composite(df, ["cell", "season"], "ix", share, ["a", "b", "c"], ["k", "n"])
    both = one(obs.filter("season < 4"), 0.9).union(one(obs.filter("season = 4"), 0.5))
    return both.select("cell", "season", F.round("target", 6).alias("target"), "a", "b", "c", *[F.round(f"{x}_{s}", 4).alias(f"{x}_{s}") for x in "abc" for s in ("median", "sd")])


_codes = "f as (select c_custkey, case when c_custkey % 3 = 0 then n_regionkey + 1 end code, case when c_custkey % 3 = 1 then (['I','II','III','IV','V'])[n_regionkey + 1] end roman, case when c_custkey % 17 = 0 then 'unknown' else r_name end label from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey), z as (select f.*, coalesce(code, ro.k, nm.k) resolved, case when code is not null then 'code' when ro.k is not null then 'roman' when nm.k is not null then 'label' end source from f left join (select unnest(['I','II','III','IV','V']) a, unnest([1,2,3,4,5]) k) ro on ro.a = roman left join (select r_name a, r_regionkey + 1 k from region) nm on nm.a = label)"


def coded(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    f = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    k, code = F.col("c_custkey"), F.col("n_regionkey") + 1
    roman = ["I", "II", "III", "IV", "V"]
    f = f.select("c_custkey", F.when(k % 3 == 0, code).alias("code"), F.when(k % 3 == 1, F.get(F.array(*map(F.lit, roman)), (code - 1).cast("int"))).alias("roman"), F.when(k % 17 == 0, "unknown").otherwise(F.col("r_name")).alias("label"))
    numerals = spark.createDataFrame([(a, i) for i, a in enumerate(roman, 1)], "alias string, code int")
    return filling.resolve_codes(f, "code", {"roman": numerals, "label": r.select(F.col("r_name").alias("alias"), (F.col("r_regionkey") + 1).alias("code"))})


@query("flt17_code_resolution", f"with {_codes} select c_custkey, resolved::int resolved, source from z")
def code_resolution(spark, d):
    """Every customer's region code: its own, or by numeral, or by name."""
    return coded(spark, d).select("c_custkey", "resolved", "source")


@query("flt17_code_faults", f"with {_codes}, p as (select distinct resolved, label from z where resolved is not null) select 'no code' fault, count(*) n from z where resolved is null union all select 'code of two names', count(*) from (select resolved from p group by 1 having count(*) > 1) union all select 'name of two codes', count(*) from (select label from p group by 1 having count(*) > 1)")
def code_faults(spark, d):
    return filling.code_faults(coded(spark, d), "label")
