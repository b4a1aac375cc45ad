"""Further queries: scenario grids, contracts, screening, simulation, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.operators.nearest import nearest_other
from veldt.operators.ranges import quantiles
from veldt.operators.series import pack
from veldt.operators.simulate import pixel_bootstrap, supf_null
from veldt.plans.cubes import GRID, SERIES, ZONES, grid, series, zones
from veldt.queries import query
from veldt.queries.breaks import yearly
from veldt.sources.tables import table


@query("flt09_candidate_pruning", f"with {SERIES} select cell, count(v) n from series where t between 7981 and 7999 group by 1 having count(v) >= 15")
def pruning(spark, d):
    return series(spark, d).filter("t between 7981 and 7999").groupBy("cell").agg(F.count("v").alias("n")).filter("n >= 15")


@query("flt24_harmonise", "select s_suppkey, round(case when s_suppkey % 2 = 0 then 0.0183::double + 0.885::double*(s_acctbal/10000) else s_acctbal/10000 end, 6) refl from supplier")
def harmonise(spark, d):
    r = F.col("s_acctbal") / 10000
    return table(spark, d, "supplier").select("s_suppkey", F.round(F.when(F.col("s_suppkey") % 2 == 0, 0.0183 + 0.885 * r).otherwise(r), 6).alias("refl"))


@query("flt25_gate_kinds", "select l_returnflag, case when l_quantity is null then 'invalid' when l_discount > 0.08 then 'range' when l_tax > 0.07 then 'far' else 'ok' end kind, count(*) n from lineitem group by 1, 2")
def gate_kinds(spark, d):
    kind = F.when(F.col("l_quantity").isNull(), "invalid").when(F.col("l_discount") > 0.08, "range").when(F.col("l_tax") > 0.07, "far").otherwise("ok")
    return table(spark, d, "lineitem").groupBy("l_returnflag", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("flt34_age_scenarios", "select n_nationkey, age, n_nationkey*age/100e0 scaled from nation, (select unnest([80, 100, 120]) age)")
def ages(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(80), F.lit(100), F.lit(120))).alias("age")).withColumn("scaled", F.col("n_nationkey") * F.col("age") / 100.0)


@query("flt36_status_packing", "select user_id, case when count(*) >= 80 then 1 when count(*) >= 60 then 2 when count(*) >= 40 then 3 else 0 end status, count(*) n from events group by 1")
def status(spark, d):
    n = F.count("*")
    return table(spark, d, "events").groupBy("user_id").agg(F.when(n >= 80, 1).when(n >= 60, 2).when(n >= 40, 3).otherwise(0).alias("status"), n.alias("n"))


@query("join02_ratio_grid", "with g as (select a, b, a/b::double r, printf('%.17g', a/b::double) k from (select unnest([9, 10, 11]) a), (select unnest([9, 10, 11]) b)), u as (select k, min(r) r from g group by 1) select a, b, round(u.r*100, 6) pct from g join u using (k)")
def ratio_grid(spark, d):
    g = spark.range(9, 12).select(F.col("id").cast("int").alias("a"), F.explode(F.array(F.lit(9), F.lit(10), F.lit(11))).alias("b"))
    g = g.withColumn("r", F.col("a") / F.col("b")).withColumn("k", F.format_string("%.17g", "r"))
    return g.join(F.broadcast(g.groupBy("k").agg(F.min("r").alias("u"))), "k").select("a", "b", F.round(F.col("u") * 100, 6).alias("pct"))


@query("join09_point_in_zone", "with z as (select n_nationkey k, n_nationkey*400 - 1000 lo, n_nationkey*400 - 600 hi from nation) select c_custkey, k as zone from customer join z on c_acctbal >= lo and c_acctbal < hi")
def point_in_zone(spark, d):
    """Intervals of one width become an equi-key; the bounds are checked after the join."""
    z = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), (F.col("n_nationkey") * 400 - 1000).alias("lo"), (F.col("n_nationkey") * 400 - 600).alias("hi")).withColumn("k", F.floor((F.col("lo") + 1000) / 400))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.floor((F.col("c_acctbal") + 1000) / 400).alias("k"))
    return c.join(F.broadcast(z), "k").filter("c_acctbal >= lo and c_acctbal < hi").select("c_custkey", "zone")


@query("join13_scenarios", "select r_name, p, f::int fold from region, (select unnest(['early', 'late']) p), (select unnest(range(5)) f)")
def scenarios(spark, d):
    return table(spark, d, "region").select("r_name", F.explode(F.array(F.lit("early"), F.lit("late"))).alias("p")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))


@query("join16_level_lookup", "with k as (select user_id % 20 k, count(*) n from events group by 1) select event_id, n from events join k on k.k = user_id % 20")
def level_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("k"))
    return e.join(F.broadcast(e.groupBy("k").agg(F.count("*").alias("n"))), "k").select("event_id", "n")


@query("join18_nn", "select a.s_suppkey, round(min(abs(a.s_acctbal - b.s_acctbal)), 6) gap from supplier a join supplier b on a.s_suppkey <> b.s_suppkey group by 1")
def nearest(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return nearest_other(s, ["s_acctbal"], "s_suppkey").select("s_suppkey", F.round("distance", 6).alias("gap"))


@query("join21_three_keys", "select o_custkey, year(o_orderdate)::int y, o_orderstatus, count(*) n from orders join lineitem on l_orderkey = o_orderkey and year(l_shipdate) = year(o_orderdate) group by 1, 2, 3")
def three_keys(spark, d):
    o, li = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), table(spark, d, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("ly"))
    return o.join(li, (o.o_orderkey == li.l_orderkey) & (o.y == li.ly)).groupBy("o_custkey", "y", "o_orderstatus").agg(F.count("*").alias("n"))


@query("agg04_zonal", f"with {GRID} select row // 5 as zone, round(sum(v), 2) s, round(min(v), 4) lo, count(v) n from grid group by 1")
def zonal(spark, d):
    return grid(spark, d).groupBy(F.floor(F.col("row") / 5).cast("int").alias("zone")).agg(F.round(F.sum("v"), 2).alias("s"), F.round(F.min("v"), 4).alias("lo"), F.count("v").alias("n"))


@query("agg21_tuning_score", "with e as (select event_type p, user_id % 3 q, abs(avg(value) - 50)/50 cov, avg(greatest(0, 50 - value))/50 under, avg(abs(value-50))/stddev_samp(value) pin from events group by 1, 2) select p, round(avg(cov + 0.5*under + 0.1*pin), 6) score from e group by 1")
def tuning(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("p"), (F.col("user_id") % 3).alias("q")).agg((F.abs(F.avg(v) - 50) / 50).alias("cov"), (F.avg(F.greatest(F.lit(0.0), 50 - v)) / 50).alias("under"), (F.avg(F.abs(v - 50)) / F.stddev_samp(v)).alias("pin"))
    return e.groupBy("p").agg(F.round(F.avg(F.col("cov") + 0.5 * F.col("under") + 0.1 * F.col("pin")), 6).alias("score"))


@query("agg45_age_distribution", "select min(p_size) lo, max(p_size) hi, round(quantile_cont(p_size, 0.1), 6) q10, round(quantile_cont(p_size, 0.95), 6) q95, count(*) filter (where p_size >= 40) old, max(p_size) filter (where p_size < 48) below from part")
def age_distribution(spark, d):
    s = F.col("p_size")
    q = quantiles(table(spark, d, "part"), "p_size", [0.1, 0.95]).agg(F.round(F.min("q"), 6).alias("q10"), F.round(F.max("q"), 6).alias("q95"))
    return table(spark, d, "part").join(F.broadcast(q)).agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.max("q10").alias("q10"), F.max("q95").alias("q95"), F.count_if(s >= 40).alias("old"), F.max(F.when(s < 48, s)).alias("below"))


@query("win11_family_bh", "with p as (select event_type fam, user_id, (1 + count(*))/200e0 p from events group by 1, 2), l as (select fam, p, count(*) k from p group by 1, 2), r as (select *, p*sum(k) over (partition by fam)/sum(k) over (partition by fam order by p)::double raw from l), q as (select fam, p, least(1, min(raw) over (partition by fam order by p desc)) q from r) select fam, user_id, round(q, 6) q from p join q using (fam, p)")
def family_bh(spark, d):
    from veldt.operators.fdr import adjust

    p = table(spark, d, "events").groupBy(F.col("event_type").alias("fam"), "user_id").agg(((1 + F.count("*")) / 200.0).alias("p"))
    return adjust(p, ["fam"]).select("fam", "user_id", F.round("q_bh", 6).alias("q"))


@query("win21_windows", f"with {SERIES}, w as (select * from (values ('a', 7981, 7990), ('b', 7985, 7999), ('c', 7981, 8010)) v(name, t0, t1)) select cell, name, count(v) n, round(avg(v), 4) mean from series join w on t between t0 and t1 group by 1, 2")
def windows(spark, d):
    dim = spark.createDataFrame([("a", 7981, 7990), ("b", 7985, 7999), ("c", 7981, 8010)], "name string, t0 int, t1 int")
    return series(spark, d).join(F.broadcast(dim), F.col("t").between(F.col("t0"), F.col("t1"))).groupBy("cell", "name").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("srt05_vif", None)
def vif(spark, d):
    """Variance inflation of the line's figures; the largest above ten goes, until none is. Only p x p sums reach the driver."""
    import numpy as np

    cols, gone = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], []
    li = table(spark, d, "lineitem").select(*cols)
    r = li.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in cols for b in cols]).first()
    while len(cols) > 1:
        v = np.diag(np.linalg.inv(np.array([[r[f"{a}|{b}"] for b in cols] for a in cols]) + 1e-12 * np.eye(len(cols))))
        if v.max() <= 10:
            break
        gone.append(cols.pop(int(v.argmax())))
    return spark.createDataFrame([(c, True) for c in cols] + [(c, False) for c in gone], "feature string, kept boolean")


@query("stat41_window_difference", f"with {SERIES}, {ZONES}, p as (select zone, t % 4 q, avg(v) filter (where t < 7993) e, avg(v) filter (where t >= 7993) l from series join zones using (cell) group by 1, 2) select zone, q::int q, round(100*(l/e-1), 6) change from p where e is not null and l is not null")
def window_difference(spark, d):
    p = series(spark, d).join(F.broadcast(zones(spark, d)), "cell").groupBy("zone", (F.col("t") % 4).cast("int").alias("q")).agg(F.avg(F.when(F.col("t") < 7993, F.col("v"))).alias("e"), F.avg(F.when(F.col("t") >= 7993, F.col("v"))).alias("l"))
    return p.filter("e is not null and l is not null").select("zone", "q", F.round(100 * (F.col("l") / F.col("e") - 1), 6).alias("change"))


@query("stat46_block_modes", "with b as (select p_size // 8 as b, count(*) n from part group by 1) select b as block, n, n >= 0.8*(select median(n) from b) usable from b")
def block_modes(spark, d):
    b = table(spark, d, "part").groupBy(F.floor(F.col("p_size") / 8).cast("int").alias("block")).agg(F.count("*").alias("n"))
    return b.join(F.broadcast(b.agg(F.median("n").alias("m")))).select("block", "n", (F.col("n") >= 0.8 * F.col("m")).alias("usable"))


@query("stat50_flags", "with b as (select c_mktsegment s, count(*) n, stddev_samp(c_acctbal)/avg(c_acctbal) cv from customer group by 1) select s, concat_ws(',', case when n < 305 then 'few' end, case when cv > 0.63 then 'uneven' end) flags from b")
def flags(spark, d):
    b = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n"), (F.stddev_samp("c_acctbal") / F.avg("c_acctbal")).alias("cv"))
    return b.select("s", F.concat_ws(",", F.when(F.col("n") < 305, "few"), F.when(F.col("cv") > 0.63, "uneven")).alias("flags"))


@query("stat17_null", None)
def null(spark, d):
    return supf_null(spark, 2000, 20, 5, 0.35).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by stat)").alias("c95"))


@query("stat23_pixel_boot", None)
def pixel_boot(spark, d):
    return pixel_bootstrap(pack(yearly(spark, d)), 200, 5, 0.2, 12.0)


@query("grf03_overlap", "with k as (select l_orderkey, count(distinct l_suppkey) n from lineitem group by 1) select count(*) orders, count(*) filter (where n > 1) shared, round(count(*) filter (where n > 1)/count(*)::double, 6) fraction from k")
def overlap(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return k.agg(F.count("*").alias("orders"), F.count_if(F.col("n") > 1).alias("shared"), F.round(F.count_if(F.col("n") > 1) / F.count("*"), 6).alias("fraction"))


@query("val01_contract", "select 'duplicate key' problem, count(*) n from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) union all select 'negative quantity', count(*) from lineitem where l_quantity < 0 union all select 'unknown flag', count(*) from lineitem where l_returnflag not in ('A', 'N', 'R')")
def contract(spark, d):
    li = table(spark, d, "lineitem")
    dup = li.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate key").alias("problem"), "n")
    rest = li.agg(F.count_if(F.col("l_quantity") < 0).alias("negative quantity"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("unknown flag"))
    return dup.union(rest.unpivot([], ["negative quantity", "unknown flag"], "problem", "n"))


@query("val03_reconcile", "select (select count(*) from lineitem) total, (select sum(n)::bigint from (select l_returnflag, count(*) n from lineitem group by 1)) by_flag")
def reconcile(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return table(spark, d, "lineitem").agg(F.count("*").alias("total")).join(F.broadcast(g.agg(F.sum("n").alias("by_flag"))))
