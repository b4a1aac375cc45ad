"""Block partitions in all modes, intervals of Moran's I and when they hold, the full set of contrasts, changes with intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import partitions
from veldt.operators.blocks import weights
from veldt.operators.series import pack
from veldt.operators.spatial import QUEEN, moran_from, moran_sums
from veldt.operators.trend import with_trend
from veldt.queries import query
from veldt.queries.blocks import B, w_sql
from veldt.sources.shared import cut
from veldt.sources.tables import table

_cells = "cells as (select l_partkey // 20 as row, (day(l_shipdate) - 1)::bigint as col, sum(l_quantity) v from lineitem where not (l_partkey // 20 % 9 = 2 and day(l_shipdate) < 8) group by 1, 2), shape as (select max(row) + 1 n_rows, 31 n_cols from cells)"
#: mode, size and offset of the partitions.
PARTS = [("balanced", (9, 8), (0, 0)), ("partial", (9, 8), (4, 3)), ("drop", (9, 8), (4, 3))]


def day_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cells, shape): quantity of twenty parts' lines by day of the month; some cells are missing."""
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_partkey") / 20).alias("row"), (F.dayofmonth("l_shipdate") - 1).cast("long").alias("col"), "l_quantity")
    cells = li.filter(~((F.col("row") % 9 == 2) & (F.col("col") < 7))).groupBy("row", "col").agg(F.sum("l_quantity").alias("v"))
    return cells, cells.agg((F.max("row") + 1).alias("rows"), F.lit(31).alias("cols"))


def _axis_sql(i: str, n: str, size: int, off: int, mode: str) -> tuple[str, str, str]:
    if mode == "balanced":
        g = f"greatest(1, {n} // {size})"
        b = f"(case when {i} < ({n} % {g})*({n} // {g} + 1) then {i} // ({n} // {g} + 1) else {n} % {g} + ({i} - ({n} % {g})*({n} // {g} + 1)) // ({n} // {g}) end)"
        first = f"({b}*({n} // {g}) + least({b}, {n} % {g}))"
        return b, first, f"({first} + {n} // {g} + ({b} < {n} % {g})::int)"
    if mode == "partial":
        b = f"(({i} + {off}) // {size})"
        return b, f"greatest(0, {b}*{size} - {off})", f"least({n}, ({b} + 1)*{size} - {off})"
    b = f"(({i} - {off}) // {size})"
    return b, f"({b}*{size} + {off})", f"({b}*{size} + {off} + {size})"


def _assign_sql(mode: str, size: tuple[int, int], off: tuple[int, int]) -> str:
    r, c = _axis_sql("row", "n_rows", size[0], off[0], mode), _axis_sql("col", "n_cols", size[1], off[1], mode)
    keep = f"where row >= {off[0]} and col >= {off[1]} and {r[2]} <= n_rows and {c[2]} <= n_cols" if mode == "drop" else ""
    return f"select row, col, v, {r[0]} || '_' || {c[0]} as block, {r[1]} r0, {r[2]} r1, {c[1]} c0, {c[2]} c1 from cells, shape {keep}"


@query("stat46_block_partition", f"with {_cells}, a as (" + " union all ".join(f"select '{m}' as mode, * from ({_assign_sql(m, s, o)})" for m, s, o in PARTS) + ") select mode, block, r0, r1, c0, c1, count(*) n, sum(v) total from a group by all")
def block_partition(spark, d):
    """Every block of three partitions, with its bounds, cells and sum."""
    cells, shape = day_cells(spark, d)
    parts = [partitions.assign(cells, shape, s, o, m).select(F.lit(m).alias("mode"), "block", "r0", "r1", "c0", "c1", "v") for m, s, o in PARTS]
    return reduce(DataFrame.union, parts).groupBy("mode", "block", "r0", "r1", "c0", "c1").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


_queen = "abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and (a.row <> b.row or a.col <> b.col)"
_i = lambda p="": f"n/{p}pairs*(xx - sx/n*xs + sx/n*sx/n*{p}pairs)/(sxx - sx*sx/n)"


def _interval_sql(mode: str, size: tuple[int, int], off: tuple[int, int]) -> str:
    return f"""select * from (with {_cells}, ab as ({_assign_sql(mode, size, off)}), s1 as (select block, count(*)::double n, sum(v) sx, sum(v*v) sxx from ab group by 1),
s2 as (select a.block, count(*)::double pairs, sum(a.v*b.v) xx, sum(a.v + b.v) xs from ab a join ab b on a.block = b.block and {_queen} group by 1), us as (select block, n, sx, sxx, coalesce(pairs, 0) pairs, coalesce(xx, 0) xx, coalesce(xs, 0) xs from s1 left join s2 using (block) where n >= 10),
t1 as (select count(*)::double n, sum(v) sx, sum(v*v) sxx from cells), t2 as (select count(*)::double pairs, sum(a.v*b.v) xx, sum(a.v + b.v) xs from cells a join cells b on {_queen}), full_ as (select n::double cells, {_i()} i from t1, t2),
own as (select count(*) n_blocks, stddev_samp(n)/avg(n) spread, sum(n) held, sum(n) n, sum(sx) sx, sum(sxx) sxx, sum(pairs) pairs, sum(xx) xx, sum(xs) xs from us), part as (select n_blocks, spread, held, {_i()} part from own),
{w_sql('', 23, 'select block from us')}, rp as (select rep, sum(w*n) n, sum(w*sx) sx, sum(w*sxx) sxx, sum(w*pairs) pairs, sum(w*xx) xx, sum(w*xs) xs from us join wt using (block) group by 1), ip as (select {_i()} ip from rp),
q as (select count(*) n_finite, avg(ip) mean, stddev_samp(ip) se, quantile_cont(ip, 0.025) lo, quantile_cont(ip, 0.975) hi from ip)
select '{mode}' as mode, n_blocks, n_finite, i, part, mean, se, i + part - hi basic_low, i + part - lo basic_high, i + lo - part percentile_low, i + hi - part percentile_high, held/cells coverage, part - i difference, spread from part, q, full_)"""


_all = " union all ".join(_interval_sql(*p) for p in PARTS)
FIGURES = ["i", "part", "mean", "se", "basic_low", "basic_high", "percentile_low", "percentile_high", "coverage", "difference", "spread"]


def intervals(spark: SparkSession, d: str) -> DataFrame:
    cells, shape = day_cells(spark, d)
    cells = cut(cells)
    s = moran_sums(cells)
    whole = s.select("n", moran_from(*[F.col(c) for c in ("n", "sx", "sxx", "w", "xx", "xs")]).alias("i"))
    out = []
    for mode, size, off in PARTS:
        sums = cut(moran_sums(partitions.assign(cells, shape, size, off, mode), QUEEN, ["block"]).withColumnRenamed("w", "pairs"))
        one = partitions.moran_interval(sums, whole, B, 23, least=10)
        out.append(one.select(F.lit(mode).alias("mode"), *one.columns, partitions.reasons(mode).alias("reasons")))
    return reduce(DataFrame.union, out)


@query("stat49_moran_interval", f"with a as ({_all}) select mode, n_blocks, n_finite, {', '.join(f'round({c}, 6) {c}' for c in FIGURES)} from a")
def moran_interval(spark, d):
    """Both intervals about the whole grid's I for each partition."""
    return intervals(spark, d).select("mode", "n_blocks", "n_finite", *[F.round(c, 6).alias(c) for c in FIGURES])


@query("stat50_interval_flags", f"""with a as ({_all}), r as (select mode, concat_ws(',', case when n_blocks < 20 then 'fewer_than_20_blocks' end, case when coverage < 0.95 then 'coverage_below_95pct' end, case when abs(difference) > 0.05 then 'partition_difference_too_large' end, case when spread > 0.5 then 'valid_pixels_per_block_cv_too_large' end, case when mode = 'partial' then 'partial_edge_blocks_equal_weight' end) reasons from a) select mode, reasons, reasons = '' reliable from r""")
def interval_flags(spark, d):
    return intervals(spark, d).select("mode", "reasons", (F.col("reasons") == "").alias("reliable"))


#: Which groups of predictors a scenario holds.
SCENARIOS = {"S0_Env": "E", "S1a_Prod": "P", "S1b_Het": "H", "S1c_Temp": "T", "S2a_Prod_Het": "PH", "S2b_Prod_Temp": "PT", "S2c_Het_Temp": "HT", "S3_RS_Full": "PHT", "S4_Integrated": "EPHT"}
#: Contrasts as (id, reduced, full) and, for substitutions, (id, C, C+B, A+C, A+B+C).
REMOVALS = [("R_AllRS_from_Integrated", "S0_Env", "S4_Integrated"), ("R_Env_from_Integrated", "S3_RS_Full", "S4_Integrated"), ("R_Prod_from_RSFull", "S2c_Het_Temp", "S3_RS_Full"), ("R_Het_from_RSFull", "S2b_Prod_Temp", "S3_RS_Full"), ("R_Temp_from_RSFull", "S2a_Prod_Het", "S3_RS_Full"), ("R_ProdHet_from_RSFull", "S1c_Temp", "S3_RS_Full"), ("R_ProdTemp_from_RSFull", "S1b_Het", "S3_RS_Full"), ("R_HetTemp_from_RSFull", "S1a_Prod", "S3_RS_Full")]
MARGINALS = [("M_Prod_given_Het", "S1b_Het", "S2a_Prod_Het"), ("M_Prod_given_Temp", "S1c_Temp", "S2b_Prod_Temp"), ("M_Prod_given_HetTemp", "S2c_Het_Temp", "S3_RS_Full"), ("M_Het_given_Prod", "S1a_Prod", "S2a_Prod_Het"), ("M_Het_given_Temp", "S1c_Temp", "S2c_Het_Temp"), ("M_Het_given_ProdTemp", "S2b_Prod_Temp", "S3_RS_Full"), ("M_Temp_given_Prod", "S1a_Prod", "S2b_Prod_Temp"), ("M_Temp_given_Het", "S1b_Het", "S2c_Het_Temp"), ("M_Temp_given_ProdHet", "S2a_Prod_Het", "S3_RS_Full"), ("M_Env_given_RSFull", "S3_RS_Full", "S4_Integrated"), ("M_RSFull_given_Env", "S0_Env", "S4_Integrated")]
SUBSTITUTIONS = [("S_Prod_Temp_given_Het", "S1b_Het", "S2c_Het_Temp", "S2a_Prod_Het", "S3_RS_Full"), ("S_Prod_Het_given_Temp", "S1c_Temp", "S2c_Het_Temp", "S2b_Prod_Temp", "S3_RS_Full"), ("S_Het_Temp_given_Prod", "S1a_Prod", "S2b_Prod_Temp", "S2a_Prod_Het", "S3_RS_Full")]
#: (family, contrast, scenario, sign): a contrast is the signed sum of its scenarios' R2.
TERMS = [(f, c, s, k) for f, rows in (("Block_removal_8", REMOVALS), ("RS_marginal_9", MARGINALS[:9]), ("Env_RS_complementarity_2", MARGINALS[9:])) for c, low, full in rows for s, k in ((full, 1), (low, -1))]
TERMS += [("RS_substitution_3", c, s, k) for c, *four in SUBSTITUTIONS for s, k in zip(four, (-1, 1, 1, -1), strict=True)]
KEYS = {"E": "e", "P": "p", "H": "h", "T": "t"}
_key = lambda held: "'" + held + "'" + "".join(f"||'|'||{KEYS[k]}" for k in held)
_r2 = f"""o as (select o_custkey % 40 as block, (o_totalprice*100)::bigint/1e5 y, o_custkey % 9 e, c_mktsegment p, c_nationkey h, o_orderpriority t from orders join customer on o_custkey = c_custkey),
ce as (select block, e, p, h, t, count(*)::double n, sum(y) sy, sum(y*y) syy from o group by all), lg as ({' union all '.join(f"select '{s}' scenario, {_key(held)} k, block, n, sy, syy from ce" for s, held in SCENARIOS.items())}),
gm as (select k, sum(sy)/sum(n) m from lg group by 1), bs as (select scenario, block, sum(n) n, sum(sy) sy, sum(syy) syy, sum(syy - 2*m*sy + n*m*m) sse from lg join gm using (k) group by 1, 2)"""


def scenario_sums(spark: SparkSession, d: str) -> DataFrame:
    """scenario, block, n, sy, syy, sse: errors of each scenario's group means. Orders are summed by block and groups first."""
    o, c = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderpriority"), table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    y = F.round(F.col("o_totalprice") * 100).cast("long") / 1e5
    rows = o.join(c, o.o_custkey == c.c_custkey).select((F.col("o_custkey") % 40).alias("block"), (F.col("o_custkey") % 9).alias("e"), F.col("c_mktsegment").alias("p"), F.col("c_nationkey").alias("h"), F.col("o_orderpriority").alias("t"), y.alias("y"))
    cells = rows.groupBy("block", "e", "p", "h", "t").agg(F.count("y").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    each = F.array(*[F.struct(F.lit(s).alias("scenario"), F.concat_ws("|", F.lit(held), *[KEYS[k] for k in held]).alias("k")) for s, held in SCENARIOS.items()])
    wide = cells.select("block", "n", "sy", "syy", F.explode(each).alias("x")).groupBy("x.scenario", "x.k", "block").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy")])
    means = wide.groupBy("k").agg((F.sum("sy") / F.sum("n")).alias("m"))
    e = F.col("syy") - 2 * F.col("m") * F.col("sy") + F.col("n") * F.col("m") * F.col("m")
    return wide.join(means, "k").groupBy("scenario", "block").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy")], F.sum(e).alias("sse"))


def contrasts(r2: DataFrame, by: list[str]) -> DataFrame:
    """by, family, contrast, v from r2 (by, scenario, r2): all contrasts whose scenarios are all there."""
    terms = r2.sparkSession.createDataFrame(TERMS, "family string, contrast string, scenario string, sign int")
    size = terms.groupBy("contrast").agg(F.count(F.lit(1)).alias("__size"))
    sums = r2.join(F.broadcast(terms), "scenario").groupBy(*by, "family", "contrast").agg(F.sum(F.col("sign") * F.col("r2")).alias("v"), F.count("r2").alias("__n"))
    return sums.join(F.broadcast(size), "contrast").filter("__n = __size").select(*by, "family", "contrast", "v")


_r = "1 - sum({w}sse)/(sum({w}syy) - sum({w}sy)^2/sum({w}n))"


@query("stat38_all_contrasts", f"""with {_r2}, {w_sql('', 29, 'select distinct block from bs')}, df as (select * from (values {', '.join(repr(t) for t in TERMS)}) v(family, contrast, scenario, sign)),
r as (select scenario, rep, {_r.format(w='w*')} r2 from bs join wt using (block) group by 1, 2), ob as (select scenario, {_r.format(w='')} r2 from bs group by 1),
rv as (select family, contrast, rep, sum(sign*r2) v from r join df using (scenario) group by 1, 2, 3), ov as (select contrast, sum(sign*r2) est from ob join df using (scenario) group by 1)
select family, contrast, round(any_value(est), 6) estimate, round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.975), 6) high, count(*) n from rv join ov using (contrast) group by 1, 2""")
def all_contrasts(spark, d):
    """Removal, marginal and substitution contrasts of nine scenarios, with intervals from shared draws of blocks."""
    bs = cut(scenario_sums(spark, d))
    r2 = lambda w: (1 - F.sum(w * F.col("sse")) / (F.sum(w * F.col("syy")) - F.pow(F.sum(w * F.col("sy")), 2) / F.sum(w * F.col("n")))).alias("r2")
    drawn = bs.join(weights(bs.select("block").distinct(), [], B, 29), "block").groupBy("scenario", "rep").agg(r2(F.col("w")))
    seen = contrasts(bs.groupBy("scenario").agg(r2(F.lit(1))), []).select("contrast", F.col("v").alias("est"))
    g = contrasts(drawn, ["rep"]).groupBy("family", "contrast").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.count("v").alias("n"))
    return g.join(F.broadcast(seen), "contrast").select("family", "contrast", F.round("est", 6).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


_years = "ys as (select l_suppkey cell, year(l_shipdate) t, sum(l_extendedprice)/sum(l_quantity) v from lineitem group by 1, 2), pl as (select s_suppkey cell, r_name region, s_suppkey % 10 as block from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
#: Years of the windows whose slopes differ, and of the early and the late mean.
WINDOWS, EARLY, LATE = {"long": (1994, 2002), "short": (1997, 2002)}, (1994, 1997), (1999, 2002)
_slope = lambda w: f"select a.cell, median((b.v - a.v)/(b.t - a.t)) s from ys a join ys b on a.cell = b.cell and b.t > a.t and a.t between {w[0]} and {w[1]} and b.t between {w[0]} and {w[1]} group by 1"


@query("stat41_changes", f"""with {_years}, m as (select cell, avg(v) filter (where t between {EARLY[0]} and {EARLY[1]}) early, avg(v) filter (where t between {LATE[0]} and {LATE[1]}) late from ys group by 1),
c as (select region, block, early, late, l.s sl, s.s ss from m join ({_slope(WINDOWS['long'])}) l using (cell) join ({_slope(WINDOWS['short'])}) s using (cell) join pl using (cell) where early is not null and late is not null),
bs as (select region, block, count(*)::double n, sum(early) early, sum(late) late, sum(sl) sl, sum(ss) ss from c group by 1, 2), {w_sql('region', 31, 'select distinct region, block from bs')},
r as (select region, sum(w*early) e, sum(w*late) l, sum(w*sl)/sum(w*n) sl, sum(w*ss)/sum(w*n) ss from bs join wt using (region, block) group by region, rep),
o as (select region, sum(n)::bigint n_cells, case when sum(early) > 0 then 100*(sum(late)/sum(early) - 1) end change, sum(ss)/sum(n) - sum(sl)/sum(n) difference from bs group by 1)
select region, any_value(n_cells) n_cells, round(any_value(change), 6) change, round(quantile_cont(case when e > 0 then 100*(l/e - 1) end, 0.025), 6) change_low, round(quantile_cont(case when e > 0 then 100*(l/e - 1) end, 0.975), 6) change_high,
round(any_value(difference), 6) difference, round(quantile_cont(ss - sl, 0.025), 6) difference_low, round(quantile_cont(ss - sl, 0.975), 6) difference_high from r join o using (region) group by 1""")
def changes(spark, d):
    """Percent change between periods and difference of two windows' slopes by region, over cells that have all four; both use one set of draws."""
    li, s = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    ys = cut(li.groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("t")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("v")))
    means = ys.groupBy("cell").agg(*[F.avg(F.when(F.col("t").between(*w), F.col("v"))).alias(k) for k, w in (("early", EARLY), ("late", LATE))])
    slope = lambda k: with_trend(pack(ys.filter(F.col("t").between(*WINDOWS[k])))).select("cell", F.col("sen_slope").alias(k))
    place = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey).select(F.col("s_suppkey").alias("cell"), F.col("r_name").alias("region"), (F.col("s_suppkey") % 10).alias("block"))
    cells = means.filter("early is not null and late is not null").join(slope("long").filter("long is not null"), "cell").join(slope("short").filter("short is not null"), "cell").join(place, "cell")
    parts = ["n", "early", "late", "long", "short"]
    bs = cut(cells.groupBy("region", "block").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in parts[1:]]))
    figures = lambda w: [F.when(F.sum(w * F.col("early")) > 0, 100 * (F.sum(w * F.col("late")) / F.sum(w * F.col("early")) - 1)).alias("change"), (F.sum(w * F.col("short")) / F.sum(w * F.col("n")) - F.sum(w * F.col("long")) / F.sum(w * F.col("n"))).alias("difference")]
    reps = bs.join(weights(bs.select("region", "block"), ["region"], B, 31), ["region", "block"]).groupBy("region", "rep").agg(*figures(F.col("w")))
    ends = [F.percentile(c, p).alias(f"{c}_{k}") for c in ("change", "difference") for k, p in (("low", 0.025), ("high", 0.975))]
    seen = bs.groupBy("region").agg(F.sum("n").cast("long").alias("n_cells"), *figures(F.lit(1)))
    names = [f"{c}{k}" for c in ("change", "difference") for k in ("", "_low", "_high")]
    return reps.groupBy("region").agg(*ends).join(F.broadcast(seen), "region").select("region", "n_cells", *[F.round(c, 6).alias(c) for c in names])
