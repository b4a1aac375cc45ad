"""Domain gates, product ranges, fit statuses and the cell table's contract, each by its whole rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators.breaks import hinge_fits
from veldt.operators.calibrate import distance, domain, in_range
from veldt.operators.ranges import quantiles
from veldt.queries import query
from veldt.queries.breaks import FIRST, FITS, LAST, yearly
from veldt.sources.tables import table

#: Share of the reference's distances within the threshold, and what rounding may add to it.
SHARE, TOUCH = 0.975, 1e-9
THREE = ["a", "b", "c"]
_stats = ", ".join(f"avg({c}) m{c}, stddev_samp({c}) s{c}, min({c}) l{c}, max({c}) h{c}" for c in THREE)
_z = ", ".join(f"({c} - m{c})/s{c} z{c}" for c in THREE)
_d2 = "za*za*iaa + zb*zb*ibb + zc*zc*icc + 2*(za*zb*iab + za*zc*iac + zb*zc*ibc)"
GATE = f"""rws as (select l_orderkey k, l_linenumber n, year(l_shipdate) yr, l_returnflag flag, case when l_orderkey % 97 = 0 then null else l_quantity end a, l_discount b, l_tax*(1 + (l_orderkey % 53 = 0)::int) c from lineitem),
tr as (select * from rws where yr < 1999 and a is not null), ms as (select {_stats} from tr), zt as (select {_z} from tr, ms),
cv as (select covar_samp(za, za) + 1e-4 aa, covar_samp(za, zb) ab, covar_samp(za, zc) ac, covar_samp(zb, zb) + 1e-4 bb, covar_samp(zb, zc) bc, covar_samp(zc, zc) + 1e-4 cc from zt),
iv as (select (bb*cc - bc*bc)/det iaa, (ac*bc - ab*cc)/det iab, (ab*bc - ac*bb)/det iac, (aa*cc - ac*ac)/det ibb, (ab*ac - aa*bc)/det ibc, (aa*bb - ab*ab)/det icc from (select *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) det from cv)),
thr as (select quantile_cont({_d2}, {SHARE}) t from zt, iv),
gate as (select k, n, flag, case when a is null or b is null or c is null then 'invalid' when not (a between la and ha and b between lb and hb and c between lc and hc) then 'range' when {_d2} > t*(1 + {TOUCH}) then 'distance' else 'ok' end kind from (select *, {_z} from rws, ms where yr >= 1999), iv, thr)"""


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    """k, n, yr, flag and three predictors of a line; some lack one, and some are out of the reference's range."""
    li = table(spark, d, "lineitem")
    a = F.when(F.col("l_orderkey") % 97 != 0, F.col("l_quantity"))
    c = F.col("l_tax") * (1 + (F.col("l_orderkey") % 53 == 0).cast("int"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.year("l_shipdate").alias("yr"), F.col("l_returnflag").alias("flag"), a.alias("a"), F.col("l_discount").alias("b"), c.alias("c"))


def gated(spark: SparkSession, d: str) -> DataFrame:
    """k, n, flag, kind of the later lines against the earlier ones: invalid, then out of range, then too far, else ok."""
    rows = gate_rows(spark, d)
    old = rows.filter("yr < 1999 and a is not null")
    ref = domain(old, THREE)
    limit = quantiles(old.select(distance(ref).alias("far")), "far", [SHARE]).select((F.col("q") * (1 + TOUCH)).alias("__limit"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    kind = F.when(~whole, "invalid").when(~in_range(ref), "range").when(distance(ref) > F.col("__limit"), "distance").otherwise("ok")
    return rows.filter("yr >= 1999").join(F.broadcast(limit)).select("k", "n", "flag", kind.alias("kind"))


@query("flt25_ood_gate", f"with {GATE} select k, n, kind from gate")
def ood_gate(spark, d):
    return gated(spark, d).select("k", "n", "kind")


@query("agg40_gate_rates", f"with {GATE} select flag, count(*) n, round(100*avg((kind = 'invalid')::int), 6) invalid_pct, round(100*avg((kind = 'range')::int) filter (where kind <> 'invalid'), 6) range_pct, round(100*avg((kind = 'distance')::int) filter (where kind not in ('invalid', 'range')), 6) distance_pct from gate group by 1")
def gate_rates(spark, d):
    """Failures of each gate among the rows that reached it."""
    is_, among = lambda k: (F.col("kind") == k).cast("int"), lambda c, v: F.when(c, v)
    g = gated(spark, d).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(is_("invalid"))).alias("invalid_pct"), (100 * F.avg(among(F.col("kind") != "invalid", is_("range")))).alias("range_pct"), (100 * F.avg(among(~F.col("kind").isin("invalid", "range"), is_("distance")))).alias("distance_pct"))
    return g.select("flag", "n", *[F.round(c, 6).alias(c) for c in ("invalid_pct", "range_pct", "distance_pct")])


@query("stat53_ood_reference", f"with {GATE} " + " union all ".join([*[f"select 'centre_{c}' item, round(m{c}, 6) v from ms union all select 'scale_{c}', round(s{c}, 6) from ms union all select 'low_{c}', round(l{c}, 6) from ms union all select 'high_{c}', round(h{c}, 6) from ms" for c in THREE], *[f"select 'inverse_{x}', round(i{x}, 6) from iv" for x in ("aa", "ab", "ac", "bb", "bc", "cc")], "select 'threshold', round(t, 6) from thr"]))
def ood_reference(spark, d):
    """The reference itself: centres, scales, ranges, the ridged covariance's inverse and the threshold, a row each."""
    old = gate_rows(spark, d).filter("yr < 1999 and a is not null")
    ref = domain(old, THREE)
    items = [(f"{n}_{c}", float(v)) for n, k in (("centre", "centre"), ("scale", "scale"), ("low", "low"), ("high", "high")) for c, v in zip(THREE, ref[k], strict=True)]
    items += [(f"inverse_{THREE[i]}{THREE[j]}", float(ref["inverse"][i, j])) for i in range(3) for j in range(i, 3)]
    limit = quantiles(old.select(distance(ref).alias("far")), "far", [SHARE]).select(F.lit("threshold").alias("item"), F.col("q").alias("v"))
    return spark.createDataFrame(items, "item string, v double").union(limit).select("item", F.round("v", 6).alias("v"))


#: Scale and valid range of four products.
PRODUCTS = {"fpar": (0.01, 0.0, 1.0), "lai": (0.1, 0.0, 10.0), "gpp": (1e-4, 0.0, 0.1), "amplitude": (1e-4, 0.0, 1.0)}
_dn = {"fpar": "l_quantity*3 - 10", "lai": "l_linenumber*20", "gpp": "floor(l_extendedprice/60)", "amplitude": "floor(l_extendedprice/8)"}


@query("flt07_product_masks", "with dn as (select l_orderkey, l_linenumber, " + ", ".join(f"{e} {c}" for c, e in _dn.items()) + " from lineitem) select l_orderkey, l_linenumber, " + ", ".join(f"case when {c}*{s!r}::double between {lo!r} and {hi!r} then round({c}*{s!r}::double, 6) end {c}" for c, (s, lo, hi) in PRODUCTS.items()) + " from dn")
def product_masks(spark, d):
    """Four products' digital numbers scaled, and null out of their ranges."""
    dn = {"fpar": F.col("l_quantity") * 3 - 10, "lai": F.col("l_linenumber") * 20, "gpp": F.floor(F.col("l_extendedprice") / 60), "amplitude": F.floor(F.col("l_extendedprice") / 8)}
    masked = [F.when((dn[c] * F.lit(s)).between(lo, hi), F.round(dn[c] * F.lit(s), 6)).alias(c) for c, (s, lo, hi) in PRODUCTS.items()]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *masked)


#: Codes of a fit's status; a cell that cannot be tested has 0.
CODES = {"normal": 1, "perfect_linear": 2, "exact_hinge": 3}


@query("flt36_fit_vector", f"with {FITS} select c.cell, coalesce(tau, 0) tau, round(supf, 5) supf, round(sb, 6) slope_before, round(sb + step, 6) slope_after, (case when sb < -1e-12 and sb + step > 1e-12 then 1 else 0 end) direction, (case when tau is null then 0 else 1 end) status from (select distinct cell from yearly union select 60::int) c left join fin using (cell)")
def fit_vector(spark, d):
    """The outputs of every cell's fit as numbers; cells without a full series are kept, with status 0."""
    y = yearly(spark, d)
    fits = hinge_fits(y, FIRST, LAST)
    code = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in CODES.items()], F.lit(0))
    cells = y.select("cell").distinct().union(spark.range(1).select(F.lit(60)))
    return cells.join(fits, "cell", "left").select("cell", F.coalesce("tau", F.lit(0)).alias("tau"), F.round("supf", 5).alias("supf"), F.round("slope_before", 6).alias("slope_before"), F.round("slope_after", 6).alias("slope_after"), F.coalesce(F.col("direction_ok").cast("int"), F.lit(0)).alias("direction"), code.alias("status"))


@query("val01_cell_contract", """with c as (select case when c_custkey % 101 = 0 then 1 else c_custkey + 1 end id, case when c_custkey % 67 = 0 then 'nan'::double else c_acctbal end x, (c_custkey % 50)::double y, case when c_custkey % 89 = 0 then 'X9' else c_mktsegment end label, case when c_custkey % 71 = 0 then -1.0 else 1.0 end area from customer)
select 'repeated id' fault, (select coalesce(sum(n), 0)::bigint from (select count(*) n from c group by id having count(*) > 1)) n union all select 'id not positive', count(*) from c where id is null or id <= 0 union all select 'no place', count(*) from c where x is null or y is null or isnan(x) or isnan(y) or isinf(x) or isinf(y)
union all select 'unknown label', count(*) from c where label is null or label not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') union all select 'area not positive', count(*) from c where area is null or not area > 0""")
def cell_contract(spark, d):
    """Faults of a cell table by kind, over customers with planted ones; a sound table has none."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(F.when(k % 101 == 0, 1).otherwise(k + 1).alias("id"), F.when(k % 67 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("x"), (k % 50).cast("double").alias("y"), F.when(k % 89 == 0, "X9").otherwise(F.col("c_mktsegment")).alias("label"), F.when(k % 71 == 0, -1.0).otherwise(1.0).alias("area"))
    return cell_faults(c, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def cell_faults(cells: DataFrame, labels: list[str]) -> DataFrame:
    """fault, n for cells (id, x, y, label, area): rows of repeated ids, ids not positive, places not finite, unknown labels, areas not positive."""
    placed = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    twice = cells.groupBy("id").count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("repeated id").alias("fault"), "n")
    rest = cells.agg(F.count_if(F.col("id").isNull() | (F.col("id") <= 0)).alias("id not positive"), F.count_if(~(placed("x") & placed("y"))).alias("no place"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(labels)).alias("unknown label"), F.count_if(F.col("area").isNull() | ~(F.col("area") > 0)).alias("area not positive"))
    return twice.union(rest.unpivot([], rest.columns, "fault", "n"))
