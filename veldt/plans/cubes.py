"""The driver's tables as the engine's cubes, grids, plots and regions, with the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.sources.tables import table

#: The windows in quarters (year x 4 + quarter) and the hinge's years.
EARLY, LATE = (7981, 7988), (7997, 8004)


def series(spark: SparkSession, d: str) -> DataFrame:
    """cell (nation), t (quarter), v (mean order value), n."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    t = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("int")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("cell"), t.alias("t")).agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))


def series2(spark: SparkSession, d: str) -> DataFrame:
    """The second response on the same cells: mean quantity a quarter."""
    o, c, li = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    t = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("int")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("cell"), t.alias("t")).agg(F.avg("l_quantity").alias("v"), F.count(F.lit(1)).alias("n"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("cell"), F.col("r_name").alias("zone"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """row, col, v, area: part size by ship month; the first row has no value."""
    li, p = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"), table(spark, d, "part").select("p_partkey", "p_size")
    g = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_size").alias("row"), F.month("l_shipdate").alias("col")).agg(F.avg("l_extendedprice").alias("x"), F.sum("l_quantity").alias("area"))
    return g.select("row", "col", F.when(F.col("row") > 1, F.col("x")).alias("v"), "area")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """plot, y, and closed-form predictions p1 (segment mean), p2 (nation mean), p3 (priority mean)."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("plot"), F.col("o_totalprice").alias("y"), "c_nationkey", "c_mktsegment", "o_orderpriority", "o_custkey")
    means = [j.groupBy(k).agg(F.avg("y").alias(f"p{i}")) for i, k in enumerate(("c_mktsegment", "c_nationkey", "o_orderpriority"), 1)]
    for m in means:
        k = m.columns[0]
        j = j.join(F.broadcast(m), k)
    return j


SERIES = "series as (select c_nationkey cell, (year(o_orderdate)*4+quarter(o_orderdate))::int t, avg(o_totalprice) v, count(*) n from orders join customer on o_custkey = c_custkey group by 1, 2)"
SERIES2 = "series2 as (select c_nationkey cell, (year(o_orderdate)*4+quarter(o_orderdate))::int t, avg(l_quantity) v, count(*) n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2)"
ZONES = "zones as (select n_nationkey cell, r_name as zone from nation join region on n_regionkey = r_regionkey)"
GRID = "grid as (select p_size as row, month(l_shipdate)::int as col, case when p_size > 1 then avg(l_extendedprice) end v, sum(l_quantity) area from lineitem join part on l_partkey = p_partkey group by 1, 2)"
SCORED = "scored as (select o_orderkey plot, o_totalprice y, c_nationkey, c_mktsegment, o_orderpriority, o_custkey, avg(o_totalprice) over (partition by c_mktsegment) p1, avg(o_totalprice) over (partition by c_nationkey) p2, avg(o_totalprice) over (partition by o_orderpriority) p3 from orders join customer on o_custkey = c_custkey)"
#: Two-sided normal tail of z, as a macro-free expression.
def tail(z: str) -> str:  # noqa: E302
    x = f"(abs({z})/sqrt(2.0))"
    terms = f"list_sum(list_transform(range(0, 151), lambda k: exp(k*ln(4.0) + (2*k+1)*ln({x}) + lgamma(k+1.0) - lgamma(2.0*k+2.0))))"
    return f"(case when {z} = 0 then 1.0 when abs({z}) > 8 then 0.0 else greatest(0.0, 1 - 2/sqrt(pi())*exp(-{x}*{x})*{terms}) end)"
