"""Tables that go through the store and back: yearly stacks, manifests, commits of many tables, cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.queries import query
from veldt.sources import settings, stacks
from veldt.sources.shared import new_folder
from veldt.sources.tables import table

#: Years of the scan, in the notation of settings.
YEARS = "1997:1999"
FIRST, *_, LAST = settings.numbers(YEARS)
CELLS = "cells as (select 'price' metric, year(o_orderdate)::int as year, o_custkey cell, round(sum(o_totalprice), 2) v from orders group by 1, 2, 3 union all select 'orders', year(o_orderdate)::int as year, o_custkey, count(*)::double from orders group by 1, 2, 3)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """metric, year, cell, v: customers' sums and counts of orders by year."""
    g = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("cell")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))
    return g.unpivot(["year", "cell"], ["price", "orders"], "metric", "v").select("metric", "year", "cell", "v")


def stack(spark: SparkSession, d: str) -> str:
    root = new_folder(spark, "stack")
    stacks.write_stack(cells(spark, d), root)
    return root


@query("src02_stack_scan", f"with {CELLS} select cell, year, v from cells where metric = 'price' and year between {FIRST} and {LAST}")
def stack_scan(spark, d):
    """Three years of one metric out of a stored stack; other folders are not opened."""
    return stacks.scan_stack(spark, stack(spark, d), "price", FIRST, LAST)


@query("src14_manifest_scan", f"with {CELLS} select metric, year, count(*) n, round(sum(v), 2) total from cells where year in (1996, 1998) group by 1, 2")
def manifest_scan(spark, d):
    """Two years of both metrics by a stored stack's manifest."""
    root = stack(spark, d)
    rows = stacks.scan_manifest(spark, root, stacks.manifest_of(spark, root), ["price", "orders"], [1996, 1998])
    return rows.groupBy("metric", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("snk10_commit_all", f"with {CELLS} select 'price' as name, count(*) n from cells where metric = 'price' union all select 'orders', count(*) from cells where metric = 'orders'")
def commit_all(spark, d):
    """Two tables committed together, then committed again; readers see the last set."""
    root, c = new_folder(spark, "commit"), cells(spark, d)
    stacks.commit_all(spark, root, {"price": c.limit(0), "orders": c.limit(0)})
    stacks.commit_all(spark, root, {m: c.filter(F.col("metric") == m) for m in ("price", "orders")})
    now = stacks.committed(spark, root)
    each = [now[m].agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("name"), "n") for m in ("price", "orders")]
    return each[0].union(each[1])


@query("snk08_cached", f"with {CELLS} select year, round(avg(v), 4) mean from cells where metric = 'price' group by 1")
def cached(spark, d):
    """A result made once for its settings and read by whoever asks again."""
    root, config = new_folder(spark, "cache"), {"metric": "price", "by": ["year"]}
    make = lambda: cells(spark, d).filter("metric = 'price'").groupBy("year").agg(F.round(F.avg("v"), 4).alias("mean"))
    stacks.cached(spark, root, config, make)
    return stacks.cached(spark, root, dict(reversed(config.items())), lambda: cells(spark, d).limit(0).select("year", F.col("v").alias("mean")))
