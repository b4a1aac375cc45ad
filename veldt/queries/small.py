"""Range masks, conditional grids, reporting domains, merges and orders of the analytics engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from veldt.plans.cubes import GRID, SCORED, SERIES, SERIES2, ZONES, grid, scored, series, series2, zones
from veldt.queries import query
from veldt.sources.tables import table

#: Scale and valid range of each product.
PRODUCTS = {"fpar": (0.01, 0.0, 1.0), "lai": (0.1, 0.0, 10.0), "gpp": (1e-4, 0.0, 0.1)}


def in_product_range(dn: Column, scale: float, low: float, high: float) -> Column:
    """The scaled value, or null outside its product's range."""
    v = dn * F.lit(scale)
    return F.when(v.between(low, high), v)


@query("flt07_product_ranges", "select l_orderkey, l_linenumber, round(case when q * 0.01 between 0 and 1 then q * 0.01 end, 8) fpar, round(case when q * 3 * 0.1 between 0 and 10 then q * 3 * 0.1 end, 8) lai, round(case when q * 30 * 1e-4 between 0 and 0.1 then q * 30 * 1e-4 end, 8) gpp from (select l_orderkey, l_linenumber, l_quantity::double q from lineitem)")
def product_ranges(spark, d):
    q = F.col("l_quantity").cast("double")
    dn = {"fpar": q, "lai": q * 3, "gpp": q * 30}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(in_product_range(dn[k], *PRODUCTS[k]), 8).alias(k) for k in PRODUCTS])


@query("flt10_conditional", f"with {GRID} select \"row\", \"col\", round(case when area > 100 then v else -1 end, 6) v from grid where \"col\" <= 6 or \"row\" > 10")
def conditional(spark, d):
    g = grid(spark, d).filter("col <= 6 or row > 10")
    return g.select("row", "col", F.round(F.when(F.col("area") > 100, F.col("v")).otherwise(-1.0), 6).alias("v"))


@query("flt15_reporting_domain", f"with {ZONES}, x as (select c_nationkey cell, max(case when c_acctbal > 9900 then 'H' end) a, max(case when c_acctbal < -900 then 'L' end) b from customer group by 1) select cell, zone, a, b from x join zones using (cell) where zone in ('ASIA', 'EUROPE', 'AFRICA') and (a is not null or b is not null)")
def reporting_domain(spark, d):
    kind = lambda test, name: F.max(F.when(test, name))
    x = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg(kind(F.col("c_acctbal") > 9900, "H").alias("a"), kind(F.col("c_acctbal") < -900, "L").alias("b"))
    reported = zones(spark, d).filter(F.col("zone").isin("ASIA", "EUROPE", "AFRICA"))
    return x.filter("a is not null or b is not null").join(F.broadcast(reported), "cell").select("cell", "zone", "a", "b")


@query("flt35_cell_area", f"with {GRID} select \"row\", \"col\", round((1000 * \"row\" / 1000.0) * (1000 * \"row\" / 1000.0), 6) area_km2 from grid")
def cell_area(spark, d):
    side = F.col("row") * 1000 / 1000.0
    return grid(spark, d).select("row", "col", F.round(side * side, 6).cast("double").alias("area_km2"))


@query("join05_zero_fill", "with a as (select s_nationkey k, count(*) allocated from supplier group by 1), b as (select c_nationkey k, count(*) sampled from customer where c_acctbal < -950 group by 1) select k, allocated, coalesce(sampled, 0) sampled from a left join b using (k)")
def zero_fill(spark, d):
    allocated = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("allocated"))
    sampled = table(spark, d, "customer").filter("c_acctbal < -950").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("sampled"))
    return allocated.join(sampled, "k", "left").fillna(0, ["sampled"])


@query("join06_ordered_merge", f"with {ZONES}, ci as (select zone, c_mktsegment seg, round(avg(c_acctbal), 6) share from customer join zones on cell = c_nationkey group by 1, 2), n as (select zone, c_mktsegment seg, count(*) n from customer join zones on cell = c_nationkey where c_acctbal > 9000 group by 1, 2) select row_number() over (order by zone desc, ci.seg) place, zone, ci.seg, share, n from ci left join n using (zone, seg)")
def ordered_merge(spark, d):
    x = table(spark, d, "customer").join(F.broadcast(zones(spark, d)), F.col("cell") == F.col("c_nationkey")).select("zone", F.col("c_mktsegment").alias("seg"), "c_acctbal")
    ci = x.groupBy("zone", "seg").agg(F.round(F.avg("c_acctbal"), 6).alias("share"))
    n = x.filter("c_acctbal > 9000").groupBy("zone", "seg").agg(F.count(F.lit(1)).alias("n"))
    # a row for each zone and class, so the order is taken over a table of fixed size
    return ci.join(n, ["zone", "seg"], "left").select(F.row_number().over(Window.orderBy(F.desc("zone"), "seg")).alias("place"), "zone", "seg", "share", "n")


@query("join07_aligned_stack", f"with {SERIES}, {SERIES2} select cell, t, round(series.v / series2.v, 6) ratio, series.n + series2.n n from series join series2 using (cell, t)")
def aligned_stack(spark, d):
    a, b = series(spark, d), series2(spark, d).withColumnsRenamed({"v": "v2", "n": "n2"})
    return a.join(b, ["cell", "t"]).select("cell", "t", F.round(F.col("v") / F.col("v2"), 6).alias("ratio"), (F.col("n") + F.col("n2")).alias("n"))


@query("agg12_focal_coverage", "select o_orderpriority as kind, sum(case when o_orderstatus in ('F', 'O') then 1 else 0 end)::bigint focal, count(*) classified, round(sum(case when o_orderstatus in ('F', 'O') then 1.0 else 0.0 end)::double / count(*), 8) as share from orders group by 1")
def focal_coverage(spark, d):
    focal = F.sum(F.when(F.col("o_orderstatus").isin("F", "O"), 1).otherwise(0))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(focal.alias("focal"), F.count(F.lit(1)).alias("classified"), F.round(focal.cast("double") / F.count(F.lit(1)), 8).alias("share"))


@query("agg19_algorithm_means", f"with {SCORED}, m as (select c_nationkey fold, 'p1' algorithm, sqrt(avg((y - p1) * (y - p1))) rmse from scored group by 1 union all select c_nationkey, 'p2', sqrt(avg((y - p2) * (y - p2))) from scored group by 1 union all select c_nationkey, 'p3', sqrt(avg((y - p3) * (y - p3))) from scored group by 1) select algorithm, round(avg(rmse), 4) rmse, count(*) folds from m group by 1")
def algorithm_means(spark, d):
    s = scored(spark, d)
    folds = s.groupBy("c_nationkey").agg(*[F.sqrt(F.avg((F.col("y") - F.col(p)) * (F.col("y") - F.col(p)))).alias(p) for p in ("p1", "p2", "p3")])
    return folds.unpivot("c_nationkey", ["p1", "p2", "p3"], "algorithm", "rmse").groupBy("algorithm").agg(F.round(F.avg("rmse"), 4).alias("rmse"), F.count(F.lit(1)).alias("folds"))


#: The order in which levels are printed.
LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "4-NOT SPECIFIED")


@query("srt01_factor_levels", "select case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 when '5-LOW' then 4 when '4-NOT SPECIFIED' then 5 end as level, o_orderpriority as kind, count(*) n from orders group by 1, 2 order by 1")
def factor_levels(spark, d):
    level = reduce(lambda c, x: c.when(F.col("kind") == x[1], x[0]), enumerate(LEVELS[1:], 2), F.when(F.col("kind") == LEVELS[0], 1))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(level.alias("level"), "kind", "n").orderBy("level")


@query("set08_collection_merge", "select 'order' as sensor, o_orderkey id, o_orderdate taken from orders union all select 'item', l_orderkey * 10 + l_linenumber, l_shipdate from lineitem")
def collection_merge(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("sensor"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken"))
    b = table(spark, d, "lineitem").select(F.lit("item").alias("sensor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("taken"))
    return a.unionByName(b)


@query("src05_masked_to_float", "select event_id, case when event_id % 11 = 0 or floor(value) = 7 then null else floor(value)::double end v from events")
def masked_to_float(spark, d):
    masked = (F.col("event_id") % 11 == 0) | (F.floor("value") == 7)
    return table(spark, d, "events").select("event_id", F.when(masked, None).otherwise(F.floor("value").cast("double")).alias("v"))


@query("flt17_region_codes", "select n_nationkey cell, coalesce(a.r_regionkey, b.r_regionkey) code, n_distinct = n_rows one_to_one from nation left join region a on a.r_regionkey = n_regionkey and a.r_name <> 'ASIA' left join region b on b.r_regionkey = n_regionkey cross join (select count(distinct r_regionkey) n_distinct, count(*) n_rows from region)")
def region_codes(spark, d):
    r = table(spark, d, "region")
    unique = r.groupBy("r_regionkey").count().agg((F.max("count") == 1).alias("one_to_one"))
    named = r.filter("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("a"))
    found = table(spark, d, "nation").join(F.broadcast(named), F.col("a") == F.col("n_regionkey"), "left").join(F.broadcast(r.select(F.col("r_regionkey").alias("b"))), F.col("b") == F.col("n_regionkey"), "left")
    return found.select(F.col("n_nationkey").alias("cell"), F.coalesce("a", "b").alias("code")).crossJoin(F.broadcast(unique))


@query("flt21_geometry_equal", f"with {GRID}, g as (select 'a' as layer, min(\"row\") r0, max(\"row\") r1, min(\"col\") c0, max(\"col\") c1 from grid union all select 'b', min(\"row\"), max(\"row\"), min(\"col\"), max(\"col\") from grid where \"row\" <= 40) select layer, r0 = (select r0 from g where layer = 'a') and r1 = (select r1 from g where layer = 'a') and c0 = (select c0 from g where layer = 'a') and c1 = (select c1 from g where layer = 'a') aligned from g")
def geometry_equal(spark, d):
    extent = lambda g, name: g.agg(*[f(c).alias(f"{c}{k}") for c in ("row", "col") for k, f in enumerate((F.min, F.max))]).select(F.lit(name).alias("layer"), F.struct("row0", "row1", "col0", "col1").alias("geometry"))
    g = grid(spark, d)
    template = extent(g, "a").select(F.col("geometry").alias("template"))
    return extent(g, "a").union(extent(g.filter("row <= 40"), "b")).crossJoin(F.broadcast(template)).select("layer", (F.col("geometry") == F.col("template")).alias("aligned"))


@query("flt26_b_type", "select c_custkey cell, c_acctbal > 0 and n is null b_type from customer left join (select o_custkey, count(*) n from orders where o_orderpriority = '1-URGENT' group by 1) on o_custkey = c_custkey")
def b_type(spark, d):
    covered = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return table(spark, d, "customer").join(covered, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("cell"), ((F.col("c_acctbal") > 0) & F.col("o_custkey").isNull()).alias("b_type"))


@query("join04_lookup", "select c_custkey plot, n_name fold, n_name is not null matched from customer left join nation on n_nationkey = c_nationkey")
def lookup(spark, d):
    folds = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("fold"))
    return table(spark, d, "customer").join(F.broadcast(folds), F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("c_custkey").alias("plot"), "fold", F.col("fold").isNotNull().alias("matched"))


@query("agg14_perturbation_agreement", "with x as (select l_returnflag kind, l_quantity::double w, case when l_discount > 0.05 then 'H' when l_discount > 0.02 then 'L' end base, case when l_discount * 1.1 > 0.05 then 'H' when l_discount * 1.1 > 0.02 then 'L' end star from lineitem) select kind, round(sum(case when base = star then w else 0 end) / sum(case when base is not null and star is not null then w end), 8) agreement, round(sum(case when star is not null then w else 0 end) / sum(case when base is not null then w end), 8) retained from x group by 1")
def perturbation_agreement(spark, d):
    state = lambda v: F.when(v > 0.05, "H").when(v > 0.02, "L")
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("double").alias("w"), state(F.col("l_discount")).alias("base"), state(F.col("l_discount") * 1.1).alias("star"))
    weight = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0.0))
    both = F.col("base").isNotNull() & F.col("star").isNotNull()
    return x.groupBy("kind").agg(F.round(weight(F.col("base") == F.col("star")) / weight(both), 8).alias("agreement"), F.round(weight(F.col("star").isNotNull()) / weight(F.col("base").isNotNull()), 8).alias("retained"))


#: Fixed value: the quantile whose coverage is judged.
TAU = 0.95


@query("agg22_validation_summary", f"with {SCORED}, f as (select c_nationkey fold, avg(case when y <= p1 * 1.8 then 1.0 else 0.0 end) coverage, avg(greatest({TAU} * (y - p1 * 1.8), ({TAU} - 1) * (y - p1 * 1.8))) pinball from scored group by 1) select round(avg(coverage), 8) coverage_mean, round(stddev_samp(coverage), 8) coverage_sd, round(avg(abs(coverage - {TAU})), 8) abs_error, round(avg(greatest({TAU} - coverage, 0)), 8) undercoverage, round(avg(pinball), 4) pinball from f")
def validation_summary(spark, d):
    u = F.col("y") - F.col("p1") * 1.8
    folds = scored(spark, d).groupBy("c_nationkey").agg(F.avg(F.when(u <= 0, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.greatest(u * TAU, u * (TAU - 1))).alias("pinball"))
    gap = F.lit(TAU) - F.col("coverage")
    return folds.agg(F.round(F.avg("coverage"), 8).alias("coverage_mean"), F.round(F.stddev_samp("coverage"), 8).alias("coverage_sd"), F.round(F.avg(F.abs(gap)), 8).alias("abs_error"), F.round(F.avg(F.greatest(gap, F.lit(0.0))), 8).alias("undercoverage"), F.round(F.avg("pinball"), 4).alias("pinball"))


@query("agg23_old_age", f"with {SCORED} select o_orderpriority as cohort, round({TAU} - avg(case when y <= p2 * 1.8 then 1.0 else 0.0 end), 8) coverage_gap, round(avg(greatest({TAU} * (y - p2 * 1.8), ({TAU} - 1) * (y - p2 * 1.8))), 4) pinball, round(avg(p2 * 1.8 - y), 4) bias, round(100 * avg(case when y > p2 * 1.8 then 1.0 else 0.0 end), 6) above from scored group by 1")
def old_age(spark, d):
    u = F.col("y") - F.col("p2") * 1.8
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return scored(spark, d).groupBy(F.col("o_orderpriority").alias("cohort")).agg(F.round(F.lit(TAU) - share(u <= 0), 8).alias("coverage_gap"), F.round(F.avg(F.greatest(u * TAU, u * (TAU - 1))), 4).alias("pinball"), F.round(F.avg(-u), 4).alias("bias"), F.round(share(u > 0) * 100, 6).alias("above"))
