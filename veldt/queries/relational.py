"""Joins, filters, projections, sets, sorts, windows and aggregates of the analytics engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import bits_clear, clean, draw, normalised_difference
from veldt.operators.calibrate import apply_map, distance, domain, in_range, knots
from veldt.operators.ranges import quantiles
from veldt.plans.cubes import SERIES, ZONES, series, zones
from veldt.queries import query
from veldt.sources.sinks import key_value, scaled_int
from veldt.sources.tables import table

one = "*"


@query("flt01_finite", "with x as (select event_id, event_type, case when event_id % 13 = 0 then null when event_id % 17 = 0 then -9999 else value end v from events) select event_type, count(*) n, count(*) filter (where v is not null and v <> -9999) kept from x group by 1")
def finite_rows(spark, d):
    v = F.when(F.col("event_id") % 13 == 0, None).when(F.col("event_id") % 17 == 0, -9999.0).otherwise(F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(one).alias("n"), F.count(clean(v)).alias("kept"))


@query("flt02_survey_match", "select o_orderkey plot_id, year(o_orderdate)::int plot_year from orders where year(o_orderdate) in (1995, 1996, 1998, 1999) and o_orderstatus <> 'P'")
def survey_match(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").filter(y.isin(1995, 1996, 1998, 1999) & (F.col("o_orderstatus") != "P")).select(F.col("o_orderkey").alias("plot_id"), y.alias("plot_year"))


@query("flt03_group_overlap", "with g as (select distinct p_brand feature, p_type grp from part) select feature, count(*) n_groups from g group by 1 having count(*) > 1")
def group_overlap(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_type").alias("grp")).distinct().groupBy("feature").agg(F.count(one).alias("n_groups")).filter("n_groups > 1")


QA = "qa as (select event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) qa, ts from events)"


def qa(spark, d):
    return table(spark, d, "events").withColumn("qa", F.get_json_object("props", "$.k").cast("int"))


@query("flt04_qa_bits", f"with {QA} select event_type, count(*) n, count(*) filter (where qa & 62 = 0) clear from qa group by 1")
def qa_bits(spark, d):
    return qa(spark, d).groupBy("event_type").agg(F.count(one).alias("n"), F.count_if(bits_clear(F.col("qa"), 62)).alias("clear"))


@query("flt05_modland", f"with {QA} select event_id, case when qa & 1 = 0 and value between 0 and 50 then value end v from qa")
def modland(spark, d):
    return qa(spark, d).select("event_id", F.when(bits_clear(F.col("qa"), 1) & F.col("value").between(0, 50), F.col("value")).alias("v"))


@query("flt06_dn_scale", "select l_orderkey, l_linenumber, round(l_quantity*1000*0.0000275 - 0.2, 8) rho from lineitem where least(l_quantity*1000, 43000) >= 7273 and greatest(l_quantity*1000, 7273) <= 43636")
def dn_scale(spark, d):
    dn = F.col("l_quantity") * 1000
    return table(spark, d, "lineitem").filter((F.least(dn, F.lit(43000.0)) >= 7273) & (F.greatest(dn, F.lit(7273.0)) <= 43636)).select("l_orderkey", "l_linenumber", F.round(dn * 0.0000275 - 0.2, 8).alias("rho"))


@query("flt14_range_mask", "with r as (select min(l_quantity) a, max(l_quantity) b, min(l_tax) c, max(l_tax) e from lineitem where year(l_shipdate) < 1997 and l_discount < 0.05) select l_returnflag, count(*) n, count(*) filter (where l_quantity between a and b and l_tax between c and e) inside from lineitem, r where year(l_shipdate) >= 1997 group by 1")
def range_mask(spark, d):
    li = table(spark, d, "lineitem")
    r = li.filter("year(l_shipdate) < 1997 and l_discount < 0.05").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.min("l_tax").alias("c"), F.max("l_tax").alias("e"))
    j = li.filter("year(l_shipdate) >= 1997").join(F.broadcast(r))
    return j.groupBy("l_returnflag").agg(F.count(one).alias("n"), F.count_if(F.expr("l_quantity between a and b and l_tax between c and e")).alias("inside"))


@query("flt16_zone_normaliser", "select n_nationkey, case when n_nationkey % 7 = 0 then 'outside' else trim(' ' || r_name || ' ') end as zone from nation join region on n_regionkey = r_regionkey")
def zone_names(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    z = F.when(F.col("n_nationkey") % 7 != 0, F.concat(F.lit(" "), "r_name", F.lit(" ")))
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.coalesce(F.trim(z), F.lit("outside")).alias("zone"))


@query("flt18_label_fallback", "select s_suppkey, coalesce(nullif(trim(case when s_suppkey % 3 = 0 then ' ' else s_name end), ''), 'id-' || s_suppkey) label from supplier")
def label_fallback(spark, d):
    label = F.trim(F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")))
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.when(label != "", label), F.concat(F.lit("id-"), "s_suppkey")).alias("label"))


@query("flt19_unique_candidates", "select 'c_name' as col, count(*) - count(c_name) missing, count(distinct c_name) kinds, count(distinct c_name) = count(*) usable from customer union all select 'c_mktsegment', count(*) - count(c_mktsegment), count(distinct c_mktsegment), count(distinct c_mktsegment) = count(*) from customer")
def unique_candidates(spark, d):
    long = table(spark, d, "customer").select("c_name", "c_mktsegment").unpivot([], ["c_name", "c_mktsegment"], "col", "v")
    return long.groupBy("col").agg((F.count(one) - F.count("v")).alias("missing"), F.count_distinct("v").alias("kinds"), (F.count_distinct("v") == F.count(one)).alias("usable"))


@query("flt20_feature_groups", "select column_name feature, case when regexp_matches(column_name, 'price|discount|tax') then 'Prod' when regexp_matches(column_name, 'date') then 'Temp' when regexp_matches(column_name, 'key|number') then 'Het' else 'Env' end grp from (describe lineitem)")
def feature_groups(spark, d):
    c = F.col("feature")
    cols = table(spark, d, "lineitem").columns
    return spark.createDataFrame([(x,) for x in cols], "feature string").select("feature", F.when(c.rlike("price|discount|tax"), "Prod").when(c.rlike("date"), "Temp").when(c.rlike("key|number"), "Het").otherwise("Env").alias("grp"))


@query("flt30_pivot", f"with {SERIES} select cell, round(avg(v) filter (where t % 4 = 1), 4) q1, round(avg(v) filter (where t % 4 = 2), 4) q2, round(avg(v) filter (where t % 4 = 3), 4) q3, round(avg(v) filter (where t % 4 = 0), 4) q4 from series group by 1")
def pivoted(spark, d):
    p = series(spark, d).withColumn("q", (F.col("t") % 4).cast("int")).groupBy("cell").pivot("q", [1, 2, 3, 0]).agg(F.round(F.avg("v"), 4))
    return p.select("cell", *[F.col(str(k)).alias(f"q{k or 4}") for k in (1, 2, 3, 0)])


@query("flt31_complete", "select r_name, s seg, count(c_custkey) n from region cross join (select distinct c_mktsegment s from customer) left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_mktsegment = s and c_acctbal < 0 group by 1, 2")
def completed(spark, d):
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    found = c.filter("c_acctbal < 0").join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", F.col("c_mktsegment").alias("seg")).agg(F.count(one).alias("n"))
    dim = F.broadcast(r).crossJoin(F.broadcast(c.select(F.col("c_mktsegment").alias("seg")).distinct()))
    return dim.join(found, (dim.r_regionkey == found.n_regionkey) & (dim.seg == found.seg), "left").select("r_name", dim.seg, F.coalesce("n", F.lit(0)).alias("n"))


@query("flt32_indices", "select l_orderkey, l_linenumber, round((l_extendedprice - l_quantity*1000)/(l_extendedprice + l_quantity*1000 + 0.000001), 8) ndvi, round(2.5*(l_tax - l_discount)/(l_tax + 6*l_discount - 7.5*0.01 + 1), 8) evi from lineitem")
def indices(spark, d):
    t, k = F.col("l_tax"), F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(normalised_difference(F.col("l_extendedprice"), F.col("l_quantity") * 1000), 8).alias("ndvi"), F.round(2.5 * (t - k) / (t + 6 * k - 7.5 * 0.01 + 1), 8).alias("evi"))


@query("flt33_phenology", "select o_custkey, round(avg(dayofyear(o_orderdate)), 6) doy, max(dayofyear(o_orderdate))::int - min(dayofyear(o_orderdate))::int season from orders group by 1")
def phenology(spark, d):
    doy = F.dayofyear("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg(doy), 6).alias("doy"), (F.max(doy) - F.min(doy)).alias("season"))


@query("join01_left_trend", f"with {SERIES}, {ZONES} select zones.cell, zone, count(v) n from zones left join series on series.cell = zones.cell and t < 7985 group by 1, 2")
def left_join(spark, d):
    s = series(spark, d).filter("t < 7985").groupBy("cell").agg(F.count("v").alias("n"))
    return zones(spark, d).join(s, "cell", "left").select("cell", "zone", F.coalesce("n", F.lit(0)).alias("n"))


@query("join03_full_zone", f"with {ZONES}, a as (select zone, count(*) n_cust from customer join zones on cell = c_nationkey where c_acctbal < 0 group by 1), b as (select zone, count(*) n_supp from supplier join zones on cell = s_nationkey where s_acctbal > 9500 group by 1) select zone, coalesce(n_cust, 0) n_cust, coalesce(n_supp, 0) n_supp from a full join b using (zone)")
def full_join(spark, d):
    z = F.broadcast(zones(spark, d))
    a = table(spark, d, "customer").filter("c_acctbal < 0").join(z, F.col("c_nationkey") == F.col("cell")).groupBy("zone").agg(F.count(one).alias("n_cust"))
    b = table(spark, d, "supplier").filter("s_acctbal > 9500").join(z, F.col("s_nationkey") == F.col("cell")).groupBy("zone").agg(F.count(one).alias("n_supp"))
    return a.join(b, "zone", "full").na.fill(0)


@query("join08_point_sample", "with g as (select floor(s_acctbal/1000)::bigint k, min(s_suppkey) first_id, count(*) n from supplier group by 1) select c_custkey, first_id, n from customer left join g on k = floor(c_acctbal/1000)::bigint")
def point_sample(spark, d):
    g = table(spark, d, "supplier").groupBy(F.floor(F.col("s_acctbal") / 1000).alias("k")).agg(F.min("s_suppkey").alias("first_id"), F.count(one).alias("n"))
    return table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 1000).alias("k")).join(g, "k", "left").select("c_custkey", "first_id", "n")


KN = "kn as (select x, max(y) over (order by x) y, lead(x) over (order by x) x1, lead(max_y) over (order by x) y1 from (select x, y, max(y) over (order by x) max_y from (select x, avg(y) y from (select unnest(quantile_cont(l_extendedprice, [i/20e0 for i in range(21)])) x, unnest(quantile_cont(l_quantity, [i/20e0 for i in range(21)])) y from lineitem where l_linenumber <= 3) group by 1)))"


@query("join15_interp", f"with {KN} select l_orderkey, l_linenumber, round(case when x1 is null then y else y + (l_extendedprice-x)/(x1-x)*(y1-y) end, 6) mapped from (select * from lineitem where l_linenumber > 3) join kn on l_extendedprice >= x and (x1 is null or l_extendedprice < x1) union all select l_orderkey, l_linenumber, round((select y from kn order by x limit 1), 6) from lineitem where l_linenumber > 3 and l_extendedprice < (select min(x) from kn)")
def interpolated(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    k = knots(li.filter("l_linenumber <= 3"), "l_extendedprice", "l_quantity", 21)
    return apply_map(li.filter("l_linenumber > 3"), "l_extendedprice", k).select("l_orderkey", "l_linenumber", F.round("mapped", 6).alias("mapped"))


@query("stat52_qm_knots", f"with {KN} select round(x, 4) x, round(y, 4) y from kn")
def qm_knots(spark, d):
    return knots(table(spark, d, "lineitem").filter("l_linenumber <= 3"), "l_extendedprice", "l_quantity", 21).select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("join17_crosstab", "select c_mktsegment a, o_orderpriority b, count(*) n from customer join orders on o_custkey = c_custkey group by 1, 2")
def crosstab(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count(one).alias("n"))


@query("join19_semi", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50)")
def semi(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(li, "p_partkey", "left_semi").select("p_partkey")


@query("join20_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("join22_dimension", "select n_name, r_name, count(*) n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def dimension(spark, d):
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(one).alias("n"))


@query("join23_best_match", "with x as (select p_brand a, p_type b, count(*)::double i from part group by 1, 2), y as (select a, b, i/(sum(i) over (partition by a) + sum(i) over (partition by b) - i) iou from x) select a, b, round(iou, 6) iou from y qualify row_number() over (partition by a order by iou desc, b) = 1")
def best_match(spark, d):
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).agg(F.count(one).cast("double").alias("i"))
    y = x.withColumn("iou", F.col("i") / (F.sum("i").over(Window.partitionBy("a")) + F.sum("i").over(Window.partitionBy("b")) - F.col("i")))
    return y.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("iou"), "b"))).filter("r = 1").select("a", "b", F.round("iou", 6).alias("iou"))


@query("agg05_weighted_region", f"with {SERIES}, {ZONES} select zone, t, round(sum(v*n)/sum(n), 4) mean from series join zones using (cell) group by 1, 2")
def weighted_region(spark, d):
    return series(spark, d).join(F.broadcast(zones(spark, d)), "cell").groupBy("zone", "t").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 4).alias("mean"))


@query("agg24_profile", "with u as (unpivot (select l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name variable value v) select variable, count(*) n, min(v) lo, round(quantile_cont(v, 0.05), 6) q05, round(avg(v), 6) mean, round(median(v), 6) median, round(quantile_cont(v, 0.95), 6) q95, max(v) hi, round(stddev_samp(v), 6) sd from u group by 1")
def profile(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax"]
    u = table(spark, d, "lineitem").select(*cols).unpivot([], cols, "variable", "v")
    q = quantiles(u, "v", [0.05, 0.5, 0.95], ["variable"]).groupBy("variable").pivot("share", [0.05, 0.5, 0.95]).agg(F.first("q")).toDF("variable", "q05", "median", "q95")
    s = u.groupBy("variable").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("hi"), F.round(F.stddev_samp("v"), 6).alias("sd"))
    return s.join(F.broadcast(q), "variable").select("variable", "n", "lo", *[F.round(c, 6).alias(c) for c in ("q05", "median", "q95")], "mean", "hi", "sd")


@query("agg25_pooled_summary", "select coalesce(l_returnflag, 'pooled') flag, count(*) n, round(avg(l_quantity), 6) mean, round(stddev_samp(l_quantity), 6) sd, median(l_quantity) median, quantile_cont(l_quantity, 0.25) q25, quantile_cont(l_quantity, 0.75) q75 from lineitem group by grouping sets ((l_returnflag), ())")
def pooled_summary(spark, d):
    g = table(spark, d, "lineitem").select("l_returnflag", "l_quantity").groupingSets([["l_returnflag"], []], "l_returnflag").agg(F.count(one).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.median("l_quantity").alias("median"), F.percentile("l_quantity", 0.25).alias("q25"), F.percentile("l_quantity", 0.75).alias("q75"))
    return g.select(F.coalesce("l_returnflag", F.lit("pooled")).alias("flag"), "n", "mean", "sd", "median", "q25", "q75")


@query("agg26_stm", "select user_id, event_type, round(avg(value), 6) mean, max(value) hi, min(value) lo, round(stddev_pop(value), 6) sd, round(quantile_cont(value, 0.1), 6) p10, round(median(value), 6) p50, round(quantile_cont(value, 0.9), 6) p90, round(max(value)-min(value), 6) spread from events group by 1, 2")
def stm(spark, d):
    v = "value"
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("hi"), F.min(v).alias("lo"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.percentile(v, 0.1), 6).alias("p10"), F.round(F.median(v), 6).alias("p50"), F.round(F.percentile(v, 0.9), 6).alias("p90"), F.round(F.max(v) - F.min(v), 6).alias("spread"))


@query("agg27_medoid", "with m as (select user_id, quantile_cont(value, 0.9) target from events group by 1) select user_id, event_id, value from events join m using (user_id) qualify row_number() over (partition by user_id order by abs(value-target), event_id) = 1")
def medoid(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    m = e.groupBy("user_id").agg(F.percentile("value", 0.9).alias("target"))
    best = e.join(m, "user_id").groupBy("user_id").agg(F.min(F.struct(F.abs(F.col("value") - F.col("target")).alias("gap"), "event_id", "value")).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


@query("agg28_cv", "select event_type, round(stddev_samp(value)/(abs(avg(value)) + 0.001), 6) cv from events group by 1")
def cv(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value") / (F.abs(F.avg("value")) + 0.001), 6).alias("cv"))


@query("agg31_q7", "select c_mktsegment, round(quantile_cont(c_acctbal, 0.025), 6) low, round(quantile_cont(c_acctbal, 0.975), 6) high from customer group by 1")
def q7(spark, d):
    q = quantiles(table(spark, d, "customer"), "c_acctbal", [0.025, 0.975], ["c_mktsegment"])
    return q.groupBy("c_mktsegment").agg(F.round(F.max(F.when(F.col("share") < 0.5, F.col("q"))), 6).alias("low"), F.round(F.max(F.when(F.col("share") > 0.5, F.col("q"))), 6).alias("high"))


@query("agg32_q1", "select c_mktsegment, quantile_disc(c_acctbal, 0.25) q25, quantile_disc(c_acctbal, 0.75) q75 from customer group by 1")
def q1(spark, d):
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by c_acctbal)")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(disc(0.25).alias("q25"), disc(0.75).alias("q75"))


@query("agg40_ood_rates", "select l_returnflag, round(100*sum(l_quantity*(l_discount > 0.08)::int)/sum(l_quantity), 6) range_pct, round(100*sum(l_quantity*(l_discount <= 0.08 and l_tax > 0.07)::int)/sum(l_quantity*(l_discount <= 0.08)::int), 6) md_pct from lineitem group by 1")
def ood_rates(spark, d):
    w = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0))
    out = F.col("l_discount") > 0.08
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(100 * w(out) / F.sum("l_quantity"), 6).alias("range_pct"), F.round(100 * w(~out & (F.col("l_tax") > 0.07)) / w(~out), 6).alias("md_pct"))


@query("agg43_robust_z", "with y as (select year(o_orderdate)::int y, count(*)::double n, avg(o_totalprice) m from orders group by 1), md as (select median(m) med from y), mad as (select median(abs(m-med)) mad from y, md) select y, n, round(abs(m-med)/mad, 5) z from y, md, mad")
def robust_z(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(one).cast("double").alias("n"), F.avg("o_totalprice").alias("m"))
    md = y.agg(F.median("m").alias("med"))
    dev = y.join(F.broadcast(md)).withColumn("gap", F.abs(F.col("m") - F.col("med")))
    return dev.join(F.broadcast(dev.agg(F.median("gap").alias("mad")))).select("y", "n", F.round(F.col("gap") / F.col("mad"), 5).alias("z"))


@query("agg44_coincidence", "with c as (select floor(c_acctbal/100)::bigint k, count(*) n from customer group by 1) select n points, count(*) cells from c group by 1")
def coincidence(spark, d):
    return table(spark, d, "customer").groupBy(F.floor(F.col("c_acctbal") / 100).alias("k")).agg(F.count(one).alias("points")).groupBy("points").agg(F.count(one).alias("cells"))


@query("agg47_duplicates", "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def duplicates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(one).alias("n")).filter("n > 1")


@query("agg48_diagnostics", "select count(*) n, count(o_totalprice) prices, count(*) filter (where o_totalprice > 100000) high, count(nullif(o_orderstatus, 'P')) known from orders")
def diagnostics(spark, d):
    return table(spark, d, "orders").agg(F.count(one).alias("n"), F.count("o_totalprice").alias("prices"), F.count_if(F.col("o_totalprice") > 100000).alias("high"), F.count(F.nullif("o_orderstatus", F.lit("P"))).alias("known"))


def by_segment():
    return Window.partitionBy("c_mktsegment")


@query("win01_avg_rank", "select c_custkey, rank() over (partition by c_mktsegment order by floor(c_acctbal/100)) + (count(*) over (partition by c_mktsegment, floor(c_acctbal/100)) - 1)/2e0 r from customer")
def avg_rank(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.floor(F.col("c_acctbal") / 100))
    return c.select("c_custkey", (F.rank().over(by_segment().orderBy("v")) + (F.count(one).over(Window.partitionBy("c_mktsegment", "v")) - 1) / 2).alias("r"))


@query("win04_cummin", "select c_custkey, min(c_acctbal) over (partition by c_mktsegment order by c_custkey desc rows unbounded preceding) m from customer")
def cummin(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.min("c_acctbal").over(by_segment().orderBy(F.desc("c_custkey")).rowsBetween(Window.unboundedPreceding, 0)).alias("m"))


@query("win05_cummax", "select c_custkey, max(c_acctbal) over (partition by c_mktsegment order by c_custkey rows unbounded preceding) m from customer")
def cummax(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.max("c_acctbal").over(by_segment().orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, 0)).alias("m"))


@query("win06_cumcount", "with k as (select l_quantity::int q, count(*) n from lineitem group by 1) select q, n, sum(n) over (order by q)::bigint cum from k")
def cumcount(spark, d):
    k = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count(one).alias("n"))
    return k.withColumn("cum", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("q")))


@query("win07_fill", "with x as (select user_id, event_id, case when event_id % 3 = 0 then value end v from events) select event_id, first_value(v ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) f from x")
def fill(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(0, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.first(v, ignorenulls=True).over(w).alias("f"))


@query("win08_top1", "select p_brand, p_partkey, p_retailprice from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1")
def top1(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).filter("r = 1").select("p_brand", "p_partkey", "p_retailprice")


@query("win09_topn", "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r from part qualify r <= 5")
def topn(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 5").select("p_brand", "p_partkey", "r")


@query("win10_share", "select p_brand, p_type, round(count(*)/sum(count(*)) over (partition by p_brand)::double, 6) share from part group by 1, 2")
def share(spark, d):
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(one).alias("n"))
    return g.select("p_brand", "p_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")), 6).alias("share"))


@query("win19_season_amplitude", "with s as (select o_custkey % 100 g, avg(o_totalprice) filter (where month(o_orderdate) in (3,4,5)) spr, avg(o_totalprice) filter (where month(o_orderdate) in (6,7,8)) su, avg(o_totalprice) filter (where month(o_orderdate) in (9,10,11)) aut from orders group by 1) select g, round(su-spr, 4) sum_spr, round(aut-su, 4) aut_sum, round(su-least(spr, aut), 4) amplitude from s")
def amplitude(spark, d):
    m = F.month("o_orderdate")
    o = table(spark, d, "orders").withColumn("s", F.when(m.between(3, 5), "spr").when(m.between(6, 8), "su").when(m.between(9, 11), "aut")).groupBy((F.col("o_custkey") % 100).alias("g")).pivot("s", ["spr", "su", "aut"]).agg(F.avg("o_totalprice"))
    return o.select("g", F.round(F.col("su") - F.col("spr"), 4).alias("sum_spr"), F.round(F.col("aut") - F.col("su"), 4).alias("aut_sum"), F.round(F.col("su") - F.least("spr", "aut"), 4).alias("amplitude"))


@query("win20_year_window", "with y as (select unnest(range(1996, 2001))::int y) select y, count(*) n, round(avg(o_totalprice), 4) v from y join orders on year(o_orderdate) between y-1 and y+1 group by 1")
def year_window(spark, d):
    """Three-year pools: each order goes to at most three years, by an equi-join on the year."""
    years = F.explode(F.sequence(F.year("o_orderdate") - 1, F.year("o_orderdate") + 1)).alias("y")
    return table(spark, d, "orders").select("o_totalprice", years).filter("y between 1996 and 2000").groupBy("y").agg(F.count(one).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("v"))


@query("srt02_multi_key", "select p_partkey, p_size, p_retailprice from part order by p_size desc, p_retailprice, p_partkey limit 100")
def multi_key(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").limit(100).select("p_partkey", "p_size", "p_retailprice")


@query("srt03_argmin", "select p_brand, p_partkey, p_size from part qualify row_number() over (partition by p_brand order by p_size, p_partkey) = 1")
def argmin(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min(F.struct("p_size", "p_partkey")).alias("b")).select("p_brand", "b.p_partkey", "b.p_size")


@query("srt06_priority_sample", f"with {ZONES} select zone, c_custkey from customer join zones on cell = c_nationkey qualify row_number() over (partition by zone order by ('0x'||substr(md5('s|'||c_custkey), 1, 8))::bigint, c_custkey) <= 20")
def priority_sample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(zones(spark, d)), F.col("c_nationkey") == F.col("cell"))
    w = Window.partitionBy("zone").orderBy(draw("s", F.col("c_custkey")), "c_custkey")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 20").select("zone", "c_custkey")


@query("srt07_sample", "select c_custkey from customer order by md5('q|'||c_custkey), c_custkey limit 50")
def sample(spark, d):
    return table(spark, d, "customer").orderBy(F.md5(F.concat_ws("|", F.lit("q"), "c_custkey")), "c_custkey").limit(50).select("c_custkey")


@query("set01_union_all", "select s_nationkey nk, 's' as kind from supplier union all select c_nationkey, 'c' from customer")
def union_all(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nk"), F.lit("s").alias("kind")).unionByName(table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nk")))


@query("set02_union_fill", "select n_nationkey k, n_name as name, null::double bal from nation union all select s_nationkey, null, s_acctbal from supplier")
def union_fill(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("set03_keep_first", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def keep_first(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("set04_intersect", "select s_nationkey nk from supplier intersect select c_nationkey from customer where c_acctbal < 0")
def intersect(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nk")).intersect(table(spark, d, "customer").filter("c_acctbal < 0").select("c_nationkey"))


@query("set05_setequal", "select (select count(*) from (select n_nationkey from nation except select c_nationkey from customer)) missing, (select count(*) from (select c_nationkey from customer except select n_nationkey from nation)) extra")
def setequal(spark, d):
    n, c = table(spark, d, "nation").select("n_nationkey"), table(spark, d, "customer").select("c_nationkey")
    a, b = n.subtract(c).agg(F.count(one).alias("missing")), c.subtract(n).agg(F.count(one).alias("extra"))
    return a.join(F.broadcast(b))


@query("set06_symmetric_difference", "(select s_nationkey k from supplier where s_acctbal < 0 except select c_nationkey from customer where c_custkey < 30) union (select c_nationkey from customer where c_custkey < 30 except select s_nationkey from supplier where s_acctbal < 0)")
def symmetric_difference(spark, d):
    a, b = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").filter("c_custkey < 30").select(F.col("c_nationkey").alias("k"))
    return a.subtract(b).union(b.subtract(a))


@query("set07_rounded_dedup", "select distinct round(l_discount*1.01, 8) rho from lineitem")
def rounded(spark, d):
    return table(spark, d, "lineitem").select(F.round(F.col("l_discount") * 1.01, 8).alias("rho")).distinct()


@query("snk04_scaled_int", "select s_suppkey, greatest(-32768, least(32767, round_even(s_acctbal*2.5, 0)::int))::smallint v from supplier")
def scaled_ints(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", scaled_int(F.col("s_acctbal"), 2.5).alias("v"))


@query("snk06_key_value", "with a as (select c_mktsegment, count(*)::double n, round(avg(c_acctbal), 4) mean from customer group by 1) select c_mktsegment, 'n' metric, n as value from a union all select c_mktsegment, 'mean', mean from a")
def metric_rows(spark, d):
    a = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(one).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return key_value(a, ["c_mktsegment"], ["n", "mean"])


FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("stat54_ood_gate", None)
def ood_gate(spark, d):
    """Rows from 1999 on against those before: within range, and within the 97.5 % distance of the reference."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *FEATS)
    old = li.filter("year(l_shipdate) < 1999")
    ref = domain(old, FEATS)
    limit = quantiles(old.select(distance(ref).alias("far")), "far", [0.975]).select(F.col("q").alias("limit"))
    new = li.filter("year(l_shipdate) >= 1999").join(F.broadcast(limit))
    return new.select("l_orderkey", "l_linenumber", in_range(ref).alias("in_range"), F.when(in_range(ref), distance(ref) <= F.col("limit")).alias("near"))


@query("stat53_ood_moments", "select round(avg(l_quantity), 6) m1, round(stddev_samp(l_quantity), 6) s1, round(covar_samp(l_quantity, l_discount), 6) c12, round(covar_samp(l_quantity, l_tax), 6) c13 from lineitem where year(l_shipdate) < 1999")
def moments(spark, d):
    li = table(spark, d, "lineitem").filter("year(l_shipdate) < 1999")
    return li.agg(F.round(F.avg("l_quantity"), 6).alias("m1"), F.round(F.stddev_samp("l_quantity"), 6).alias("s1"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("c12"), F.round(F.covar_samp("l_quantity", "l_tax"), 6).alias("c13"))


@query("stat56_na_fill", "with x as (select l_orderkey, l_linenumber, l_quantity, case when (l_orderkey + l_linenumber) % 11 <> 0 then l_extendedprice end y from lineitem), f as (select regr_slope(y, l_quantity) b, regr_intercept(y, l_quantity) a, regr_r2(y, l_quantity) r2, min(y) lo, max(y) hi, avg(y) m from x) select l_orderkey, l_linenumber, round(coalesce(y, case when r2 >= 0.7 then greatest(lo, least(hi, a + b*l_quantity)) else m end), 4) y, y is null filled from x, f")
def na_fill(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 != 0, F.col("l_extendedprice")).alias("y"))
    f = x.agg(F.regr_slope("y", "l_quantity").alias("b"), F.regr_intercept("y", "l_quantity").alias("a"), F.regr_r2("y", "l_quantity").alias("r2"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("m"))
    guess = F.when(F.col("r2") >= 0.7, F.greatest("lo", F.least("hi", F.col("a") + F.col("b") * F.col("l_quantity")))).otherwise(F.col("m"))
    return x.join(F.broadcast(f)).select("l_orderkey", "l_linenumber", F.round(F.coalesce("y", guess), 4).alias("y"), F.col("y").isNull().alias("filled"))


@query("ml10_quantile_order", "select l_orderkey, l_linenumber, greatest(0, l_discount) q1, greatest(0, l_discount, l_tax) q2, greatest(0, l_discount, l_tax, l_quantity/500) q3 from lineitem")
def quantile_order(spark, d):
    a, b, c = F.greatest(F.lit(0.0), "l_discount"), F.col("l_tax"), F.col("l_quantity") / 500
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("q1"), F.greatest(a, b).alias("q2"), F.greatest(a, b, c).alias("q3"))


#: Lines of a task of a fit: vectors take some ten times what their lines take in a file.
FIT_ROWS = 250_000


def features(spark: SparkSession, d: str) -> DataFrame:
    """Lines as vectors, dealt by order so that a task of a fit holds FIT_ROWS or so, however large a file's pieces are."""
    from pyspark.ml.feature import VectorAssembler

    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax")
    li = li.repartition(max(1, -(-li.count() // FIT_ROWS)), "l_orderkey")
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(li)


def _forest(kind: str, spark, d) -> DataFrame:
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    f = features(spark, d)
    model = (RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=5, seed=7) if kind == "rf" else GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=7)).fit(f.filter("l_orderkey % 5 <> 0"))
    p = model.transform(f.filter("l_orderkey % 5 = 0"))
    e = F.col("y") - F.col("prediction")
    return p.agg(F.count(one).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count(one))).alias("r2"))


@query("ml02_rf", None)
def rf(spark, d):
    return _forest("rf", spark, d)


@query("ml03_gbt", None)
def gbt(spark, d):
    return _forest("gbt", spark, d)
