"""Trend, false discovery and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.scalars import ratio
from veldt.operators import fdr, trend
from veldt.operators.series import complete, pack, period_means
from veldt.plans.cubes import EARLY, LATE, SERIES, SERIES2, ZONES, series, series2, tail, zones
from veldt.queries import query

FULL = f"{SERIES}, full_cells as (select cell from series group by cell having count(v) >= greatest(3, ceil((select count(distinct t) from series)*0.8))), s as (select * from series where cell in (select cell from full_cells))"
PAIRS = f"{FULL}, pairs as (select a.cell, (b.v-a.v)/(b.t-a.t) slope, sign(b.v-a.v) sg from s a join s b on a.cell = b.cell and a.t < b.t)"
MK = f"""{PAIRS}, ties as (select cell, sum(k*(k-1)*(2*k+5)) tied from (select cell, v, count(*)::double k from s group by 1, 2) group by 1),
mk as (select cell, n, sen_slope, s_stat, (n*(n-1)*(2*n+5)-tied)/18e0 var_s from (select cell, count(*)::double n from s group by 1) join (select cell, median(slope) sen_slope, sum(sg)::double s_stat from pairs group by 1) using (cell) join ties using (cell)),
mkz as (select *, case when var_s > 0 then (s_stat-sign(s_stat))/sqrt(var_s) end z from mk), mkp as (select *, {tail('z')} p from mkz)"""


def trends(spark: SparkSession, d: str) -> DataFrame:
    return trend.with_trend(pack(complete(series(spark, d))))


@query("stat01_sen", f"with {PAIRS} select cell, round(median(slope), 6) sen_slope from pairs group by cell")
def sen(spark, d):
    return trends(spark, d).select("cell", F.round("sen_slope", 6).alias("sen_slope"))


@query("stat02_mk", f"with {MK} select cell, n::bigint n, s_stat::bigint s_stat, round(var_s, 6) var_s from mk")
def mk(spark, d):
    return trends(spark, d).select("cell", "n", F.col("s_stat").cast("long").alias("s_stat"), F.round("var_s", 6).alias("var_s"))


@query("stat03_mk_p", f"with {MK} select cell, round(z, 6) z, round(p, 6) p from mkp")
def mk_p(spark, d):
    return trends(spark, d).select("cell", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


HR = f"""{MK}, res as (select s.cell, s.t, round(s.v - mk.sen_slope*s.t, 9) r from s join mk using (cell)),
rk as (select cell, row_number() over (partition by cell order by t) i, count(*) over (partition by cell)::double n, rank() over (partition by cell order by r) + (count(*) over (partition by cell, r) - 1)/2e0 g from res),
ce as (select cell, i, n, g - (n+1)/2e0 m from rk), c0 as (select cell, sum(m*m) c0 from ce group by 1),
ac as (select a.cell, (b.i-a.i)::double k, any_value(a.n) n, sum(a.m*b.m)/any_value(c0) rho from ce a join ce b on a.cell = b.cell and b.i > a.i join c0 on c0.cell = a.cell group by 1, 2),
ex as (select cell, sum(case when abs(rho) > 1.96/sqrt(n) then (n-k)*(n-k-1)*(n-k-2)*rho else 0 end) e from ac group by 1),
hr as (select mk.*, greatest(1e-6, 1 + 2e0/(n*(n-1)*(n-2))*e) correction from mk join ex using (cell)), hrz as (select *, var_s*correction var_hr, case when var_s > 0 then (s_stat-sign(s_stat))/sqrt(var_s*correction) end zh from hr)"""


@query("stat04_hamed_rao", f"with {HR} select cell, round(correction, 6) correction, round(var_hr, 5) var_hr, round({tail('zh')}, 6) p_hr from hrz")
def hamed_rao(spark, d):
    return trend.with_hamed_rao(trends(spark, d)).select("cell", F.round("correction", 6).alias("correction"), F.round("var_hr", 5).alias("var_hr"), F.round("p_hr", 6).alias("p_hr"))


ADJ = f"""{MK}, rp as (select cell, sen_slope, p pr from mkp), rl as (select p, k, sum(k) over () m, sum(k) over (order by p) r from (select pr p, count(*) k from rp group by 1)),
raw as (select *, p*m/r::double raw from rl), low as (select *, min(raw) over (order by p desc) low from raw),
lev as (select *, least(1, low) q_bh, least(1, low*list_sum(list_transform(range(1, m::bigint+1), lambda i: 1.0::double/i))) q_by from low),
adj as (select rp.*, q_bh, q_by, least(1, q_bh*greatest(1, m - (select coalesce(sum(k), 0) from lev where q_bh <= 0.05/1.05))/m) q_bky from rp join lev on rp.pr = lev.p)"""


def adjusted(spark, d):
    return fdr.adjust(trends(spark, d).withColumn("family", F.lit(1)), ["family"])


def state(slope, q, alpha=0.05):
    return F.when(q.isNull(), None).when((q < alpha) & (slope > 0), "T+").when((q < alpha) & (slope < 0), "T-").otherwise("T0")


@query("stat07_bh", f"with {ADJ} select cell, round(q_bh, 6) q_bh, case when q_bh < 0.05 and sen_slope > 0 then 'T+' when q_bh < 0.05 and sen_slope < 0 then 'T-' else 'T0' end trend_state from adj")
def bh(spark, d):
    return adjusted(spark, d).select("cell", F.round("q_bh", 6).alias("q_bh"), state(F.col("sen_slope"), F.col("q_bh")).alias("trend_state"))


@query("stat08_by", f"with {ADJ} select cell, round(q_by, 6) q_by from adj")
def by(spark, d):
    return adjusted(spark, d).select("cell", F.round("q_by", 6).alias("q_by"))


@query("stat09_bky", f"with {ADJ} select cell, round(q_bky, 6) q_bky from adj")
def bky(spark, d):
    return adjusted(spark, d).select("cell", F.round("q_bky", 6).alias("q_bky"))


K99 = "counts as (select (user_id*7 + event_id) % 100 k, count(*) n from events where value > 0 group by 1)"


@query("stat10_discrete_fdr", f"with {K99}, a as (select k, n, (1+k)/100e0 p, sum(n) over () m, sum(n) over (order by k) r from counts), b as (select *, min(p*m/r::double) over (order by k desc) low from a) select k, n, round(p, 6) p, round(least(1, low), 6) q_bh from b")
def discrete_fdr(spark, d):
    from veldt.sources.tables import table

    counts = table(spark, d, "events").filter("value > 0").groupBy(((F.col("user_id") * 7 + F.col("event_id")) % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return fdr.discrete(counts, 99).select("k", "n", F.round("p", 6).alias("p"), F.round("q_bh", 6).alias("q_bh"))


@query("stat11_fdr_cutoff", f"with {K99}, a as (select k, n, (1+k)/100e0 p, sum(n) over () m, sum(n) over (order by k) r from counts), b as (select *, min(p*m/r::double) over (order by k desc) low from a) select max(p) filter (where least(1, low) <= 0.9) cutoff, count(*) levels from b")
def fdr_cutoff(spark, d):
    from veldt.sources.tables import table

    counts = table(spark, d, "events").filter("value > 0").groupBy(((F.col("user_id") * 7 + F.col("event_id")) % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return fdr.discrete(counts, 99).agg(F.max(F.when(F.col("q_bh") <= 0.9, F.col("p"))).alias("cutoff"), F.count(F.lit(1)).alias("levels"))


@query("join10_pairs", f"with {PAIRS} select cell, count(*) n_pairs, sum(case when sg > 0 then 1 else 0 end)::bigint up from pairs group by cell")
def pairs(spark, d):
    s = pack(complete(series(spark, d)))
    up = trend.pair_map(F.col("s"), lambda a, b: F.when(b["v"] > a["v"], 1).otherwise(0))
    return s.select("cell", F.size(up).cast("long").alias("n_pairs"), F.aggregate(up, F.lit(0), lambda x, y: x + y).cast("long").alias("up"))


@query("win02_acf", f"with {FULL}, ce as (select cell, row_number() over (partition by cell order by t) i, v - avg(v) over (partition by cell) m from s), c0 as (select cell, sum(m*m) c0 from ce group by 1) select a.cell, (b.i-a.i)::int lag, round(sum(a.m*b.m)/any_value(c0), 6) acf from ce a join ce b on a.cell = b.cell and b.i - a.i between 1 and 4 join c0 on c0.cell = a.cell group by 1, 2")
def acf(spark, d):
    s = pack(complete(series(spark, d)))
    mean = trend.total(F.transform("s", lambda x: x["v"])) / F.size("s")
    m = s.withColumn("mean", mean).withColumn("m", F.transform("s", lambda x: x["v"] - F.col("mean"))).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(4))))
    size = F.size("m") - F.col("lag")
    top = trend.total(F.zip_with(F.slice("m", F.lit(1), size), F.slice("m", F.col("lag") + 1, size), lambda a, b: a * b))
    return m.select("cell", "lag", F.round(top / trend.total(F.transform("m", lambda x: x * x)), 6).alias("acf"))


PM = f"""{SERIES}, {ZONES}, per as (select cell, avg(v) filter (where t between {EARLY[0]} and {EARLY[1]}) e, count(v) filter (where t between {EARLY[0]} and {EARLY[1]}) ne, avg(v) filter (where t between {LATE[0]} and {LATE[1]}) l, count(v) filter (where t between {LATE[0]} and {LATE[1]}) nl from series group by cell),
pm as (select cell, case when ne >= 7 then e end early, case when nl >= 7 then l end late from per)"""


def periods(spark, d):
    dim = spark.createDataFrame([("early", *EARLY), ("late", *LATE)], "name string, t0 int, t1 int")
    return period_means(series(spark, d), dim).groupBy("cell").pivot("name", ["early", "late"]).agg(F.first("mean"))


@query("agg50_period_mean", f"with {PM} select cell, round(early, 4) early, round(late, 4) late, round(100*(late/early-1), 6) change_pct from pm where early is not null or late is not null")
def period_change(spark, d):
    p = periods(spark, d).filter("early is not null or late is not null")
    return p.select("cell", F.round("early", 4).alias("early"), F.round("late", 4).alias("late"), F.round(100 * (F.col("late") / F.col("early") - 1), 6).alias("change_pct"))


RF = f"{PM}, q as (select zone, quantile_cont(v, 0.95) q95 from series join zones using (cell) group by 1), rf as (select cell, zone, late/q95 rf from pm join zones using (cell) join q using (zone) where late is not null)"


def state_ratio(spark, d):
    z = zones(spark, d)
    q = series(spark, d).join(F.broadcast(z), "cell").groupBy("zone").agg(F.percentile("v", 0.95).alias("q95"))
    return periods(spark, d).filter("late is not null").join(F.broadcast(z), "cell").join(F.broadcast(q), "zone").select("cell", "zone", ratio(F.col("late"), F.col("q95")).alias("rf"))


@query("stat35_state_ratio", f"with {RF} select cell, zone, round(rf, 6) rf, case when rf >= 0.8 then 'H' else 'L' end state from rf")
def ratio_state(spark, d):
    return state_ratio(spark, d).select("cell", "zone", F.round("rf", 6).alias("rf"), F.when(F.col("rf") >= 0.8, "H").otherwise("L").alias("state"))


C6 = f"{ADJ.replace(SERIES, SERIES)}, " + RF.split(f"{SERIES}, ", 1)[1] + ", c6 as (select rf.cell, zone, rf, sen_slope, pr, case when rf >= 0.8 then 'H' else 'L' end || case when pr < 0.5 and sen_slope > 0 then '+' when pr < 0.5 and sen_slope < 0 then '-' else '0' end class6 from rf join adj using (cell))"


def classes(spark, d, alpha=0.5):
    """Six classes; p below one half stands for significance here, since the tables hold no trend to speak of."""
    t = trends(spark, d).select("cell", "sen_slope", "p")
    sign = F.when((F.col("p") < alpha) & (F.col("sen_slope") > 0), "+").when((F.col("p") < alpha) & (F.col("sen_slope") < 0), "-").otherwise("0")
    return state_ratio(spark, d).join(t, "cell").withColumn("class6", F.concat(F.when(F.col("rf") >= 0.8, "H").otherwise("L"), sign))


@query("flt11_class6", f"with {C6} select cell, zone, class6 from c6")
def class6(spark, d):
    return classes(spark, d).select("cell", "zone", "class6")


ALL6 = ("H+", "H0", "H-", "L+", "L0", "L-")


@query("agg06_class_area", f"""with {C6}, area as (select cell, sum(n)::double a from series group by 1), g as (select case when grouping(zone) = 1 then 'Overall' else zone end as zone, class6, sum(a) area, count(*) n from c6 join area using (cell) group by grouping sets ((zone, class6), (class6))),
dim as (select * from (select r_name as zone from region union all select 'Overall'), (select unnest(['H+','H0','H-','L+','L0','L-']) class6))
select dim.zone, dim.class6, coalesce(area, 0) area, coalesce(n, 0) n, round(coalesce(area, 0)/nullif(sum(coalesce(area, 0)) over (partition by dim.zone), 0), 6) prop from dim left join g on g.zone = dim.zone and g.class6 = dim.class6""")
def class_area(spark, d):
    from pyspark.sql import Window

    from veldt.sources.tables import table

    area = series(spark, d).groupBy("cell").agg(F.sum("n").cast("double").alias("a"))
    c = classes(spark, d).join(area, "cell")
    g = c.groupingSets([["zone", "class6"], ["class6"]], "zone", "class6").agg(F.sum("a").alias("area"), F.count(F.lit(1)).alias("n"), F.grouping("zone").alias("g")).withColumn("zone", F.when(F.col("g") == 1, "Overall").otherwise(F.col("zone")))
    dim = table(spark, d, "region").select(F.col("r_name").alias("zone")).union(spark.range(1).select(F.lit("Overall"))).select("zone", F.explode(F.array(*map(F.lit, ALL6))).alias("class6"))
    full = F.broadcast(dim).join(g, ["zone", "class6"], "left").select("zone", "class6", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("n", F.lit(0)).alias("n"))
    whole = F.sum("area").over(Window.partitionBy("zone"))
    return full.select("zone", "class6", "area", "n", F.round(F.when(whole != 0, F.col("area") / whole), 6).alias("prop"))


@query("stat33_threshold_sweep", f"with {RF}, th as (select unnest([0.70, 0.75, 0.80, 0.85])::double threshold) select threshold, count(*) n, sum(case when rf >= threshold then 1 else 0 end)::bigint n_high from rf, th group by 1")
def sweep(spark, d):
    th = F.explode(F.array(*[F.lit(x) for x in (0.70, 0.75, 0.80, 0.85)]))
    return state_ratio(spark, d).withColumn("threshold", th).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rf") >= F.col("threshold"), 1).otherwise(0)).alias("n_high"))


@query("stat34_ratio_sweep", f"with {RF}, m as (select unnest([0.9, 0.95, 1.0, 1.05, 1.1])::double m), r as (select distinct a.m/b.m ratio, printf('%.15g', a.m/b.m) k from m a, m b), rk as (select k, min(ratio) ratio from r group by 1) select k ratio_key, sum(case when (rf >= 0.8) = (rf*ratio >= 0.8) then 1 else 0 end)::bigint agree, sum(case when rf*ratio >= 0.8 then 1 else 0 end)::bigint n_high from rf, rk group by 1")
def ratio_sweep(spark, d):
    m = [0.9, 0.95, 1.0, 1.05, 1.1]
    keys: dict[str, float] = {}
    for a in m:
        for b in m:
            k = f"{a / b:.15g}"
            keys[k] = min(keys.get(k, 9.0), a / b)
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio_key"), F.lit(v).alias("ratio")) for k, v in sorted(keys.items())]))
    r = state_ratio(spark, d).select("rf", grid.alias("g"))
    star = F.col("rf") * F.col("g.ratio") >= 0.8
    return r.groupBy(F.col("g.ratio_key").alias("ratio_key")).agg(F.sum(F.when((F.col("rf") >= 0.8) == star, 1).otherwise(0)).alias("agree"), F.sum(F.when(star, 1).otherwise(0)).alias("n_high"))


PAIR6 = f"""{SERIES}, {SERIES2}, {ZONES}, h as (select a.cell, zone, a.t, case when a.v >= (select median(v) from series) then 'H' else 'L' end c1, case when b.v >= (select median(v) from series2) then 'H' else 'L' end c2, a.n::double area from series a join series2 b on a.cell = b.cell and a.t = b.t join zones on zones.cell = a.cell)"""


def paired(spark, d):
    a, b = series(spark, d), series2(spark, d).select("cell", "t", F.col("v").alias("v2"))
    ma, mb = a.agg(F.median("v").alias("ma")), b.agg(F.median("v2").alias("mb"))
    j = a.join(b, ["cell", "t"]).join(F.broadcast(zones(spark, d)), "cell").join(F.broadcast(ma)).join(F.broadcast(mb))
    hl = lambda v, m: F.when(F.col(v) >= F.col(m), "H").otherwise("L")
    return j.select("cell", "zone", "t", hl("v", "ma").alias("c1"), hl("v2", "mb").alias("c2"), F.col("n").cast("double").alias("area"))


@query("agg10_transition", f"with {PAIR6} select coalesce(zone, 'Overall') as zone, c1, c2, sum(area) area, count(*) n from h group by grouping sets ((zone, c1, c2), (c1, c2))")
def transition(spark, d):
    return paired(spark, d).groupingSets([["zone", "c1", "c2"], ["c1", "c2"]], "zone", "c1", "c2").agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("n")).withColumn("zone", F.coalesce("zone", F.lit("Overall")))


@query("agg11_kappa", f"with {PAIR6}, g as (select zone, sum(area) a, sum(case when c1 = c2 then area else 0 end)/sum(area) po, sum(case when c1 = 'H' then area else 0 end)/sum(area) p1, sum(case when c2 = 'H' then area else 0 end)/sum(area) p2 from h group by 1) select zone, round(po, 6) agreement, round(case when abs(1-(p1*p2+(1-p1)*(1-p2))) >= 1e-15 then (po-(p1*p2+(1-p1)*(1-p2)))/(1-(p1*p2+(1-p1)*(1-p2))) end, 6) kappa from g")
def kappa(spark, d):
    w = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0)) / F.sum("area")
    g = paired(spark, d).groupBy("zone").agg(w(F.col("c1") == F.col("c2")).alias("po"), w(F.col("c1") == "H").alias("p1"), w(F.col("c2") == "H").alias("p2"))
    pe = F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))
    return g.select("zone", F.round("po", 6).alias("agreement"), F.round(F.when(F.abs(1 - pe) >= 1e-15, (F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


@query("agg13_closure", f"with {PAIR6}, s as (select zone, c1, sum(area)/sum(sum(area)) over (partition by zone) share from h group by 1, 2) select zone, abs(sum(share)-1) <= 1e-10 closed, string_agg(c1, ',' order by c1) classes from s group by 1")
def closure(spark, d):
    from pyspark.sql import Window

    g = paired(spark, d).groupBy("zone", "c1").agg(F.sum("area").alias("a")).withColumn("share", F.col("a") / F.sum("a").over(Window.partitionBy("zone")))
    return g.groupBy("zone").agg((F.abs(F.sum("share") - 1) <= 1e-10).alias("closed"), F.array_join(F.array_sort(F.collect_set("c1")), ",").alias("classes"))


@query("agg37_iou", f"with {PAIR6}, g as (select zone, count(*)::double n, count(*) filter (where c1 = 'H')/count(*)::double pa, count(*) filter (where c2 = 'H')/count(*)::double pb, count(*) filter (where c1 = 'H' and c2 = 'H')::double i, count(*) filter (where c1 = 'H' or c2 = 'H')::double u from h group by 1) select zone, round(i/u, 6) iou, round(pa*pb/(pa+pb-pa*pb), 6) expected, round((i/u - pa*pb/(pa+pb-pa*pb))/(1 - pa*pb/(pa+pb-pa*pb)), 6) adjusted from g where u > 0")
def iou(spark, d):
    a, b = F.col("c1") == "H", F.col("c2") == "H"
    k = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    g = paired(spark, d).groupBy("zone").agg((k(a) / F.count(F.lit(1))).alias("pa"), (k(b) / F.count(F.lit(1))).alias("pb"), k(a & b).alias("i"), k(a | b).alias("u")).filter("u > 0")
    raw, exp = F.col("i") / F.col("u"), F.col("pa") * F.col("pb") / (F.col("pa") + F.col("pb") - F.col("pa") * F.col("pb"))
    return g.select("zone", F.round(raw, 6).alias("iou"), F.round(exp, 6).alias("expected"), F.round((raw - exp) / (1 - exp), 6).alias("adjusted"))


@query("flt27_conflict", f"with {PAIR6} select cell, t, (case when c1 = 'H' then 1 else -1 end * case when c2 = 'H' then 1 else -1 end < 0)::int conflict from h")
def conflict(spark, d):
    sign = lambda c: F.when(F.col(c) == "H", 1).otherwise(-1)
    return paired(spark, d).select("cell", "t", (sign("c1") * sign("c2") < 0).cast("int").alias("conflict"))
