"""Grid queries: neighbours, Moran's I, Gi*, focal windows, patches, block statistics, scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import Z90, Z95, Z99, two_sided
from veldt.operators import ranges
from veldt.operators.blocks import interval, weights
from veldt.operators.spatial import QUEEN, ROOK, circle, focal_square, gi_star, moran_from, moran_sums, neighbours, patches
from veldt.plans.cubes import GRID, grid, tail
from veldt.queries import query
from veldt.queries.blocks import B, w_sql

NB = f"{GRID}, ok as (select * from grid where v is not null), nb as (select a.row, a.col, a.v, b.v nv from ok a join ok b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 and (a.row <> b.row or a.col <> b.col))"
CELL = "(select count(*)::double n, sum(v) sx, sum(v*v) sxx, avg(v) mean, stddev_pop(v) sd from ok)"


@query("join11_neighbours", f"with {NB} select row, col, count(*) n, round(sum(nv), 2) s from nb group by 1, 2")
def neighbour_sums(spark, d):
    return neighbours(grid(spark, d).select("row", "col", "v")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("nv"), 2).alias("s"))


@query("join11_rook", f"with {NB} select a.row, a.col, count(*) n from ok a join ok b on abs(a.row-b.row) + abs(a.col-b.col) = 1 group by 1, 2")
def rook(spark, d):
    return neighbours(grid(spark, d).select("row", "col", "v"), ROOK).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query("join12_block_neighbours", f"with {NB} select a.row // 10 as block, count(*) n from ok a join ok b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 and (a.row <> b.row or a.col <> b.col) and a.row // 10 = b.row // 10 group by 1")
def in_block(spark, d):
    g = grid(spark, d).select("row", "col", "v", F.floor(F.col("row") / 10).cast("int").alias("block"))
    return neighbours(g, QUEEN, ["block"]).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


I_SQL = f"{NB}, g as {CELL}, pw as (select count(*)::double w, sum((v-(select mean from g))*(nv-(select mean from g))) num from nb), mi as (select n, w, n/w*num/(sxx-n*mean*mean) i from g, pw)"


def moran(spark, d):
    s = moran_sums(grid(spark, d).select("row", "col", "v"))
    return s.withColumn("i", moran_from(*[F.col(c) for c in ("n", "sx", "sxx", "w", "xx", "xs")]))


@query("stat42_moran", f"with {I_SQL} select n::bigint n, w::bigint w, round(i, 6) i from mi")
def moran_i(spark, d):
    return moran(spark, d).select("n", "w", F.round("i", 6).alias("i"))


@query("stat43_moran_inference", f"with {I_SQL}, dg as (select sum(k*k)::double*4 s2 from (select count(*) k from nb group by row, col)), x as (select n, i, -1/(n-1) e, (n*n*2*w - n*s2 + 3*w*w)/(w*w*(n*n-1)) - 1/((n-1)*(n-1)) var from mi, dg), z as (select *, (i-e)/sqrt(var) z from x) select round(e, 6) expected, round(var, 8) variance, round(z, 4) z, round({tail('z')}, 4) p from z")
def inference(spark, d):
    g = grid(spark, d).select("row", "col", "v")
    deg = neighbours(g).groupBy("row", "col").agg(F.count(F.lit(1)).alias("k")).agg((F.sum(F.col("k") * F.col("k")).cast("double") * 4).alias("s2"))
    n, w, s2 = F.col("n").cast("double"), F.col("w").cast("double"), F.col("s2")
    x = moran(spark, d).join(F.broadcast(deg)).select("i", (-1 / (n - 1)).alias("e"), ((n * n * 2 * w - n * s2 + 3 * w * w) / (w * w * (n * n - 1)) - 1 / ((n - 1) * (n - 1))).alias("var"))
    z = x.withColumn("z", (F.col("i") - F.col("e")) / F.sqrt("var"))
    return z.select(F.round("e", 6).alias("expected"), F.round("var", 8).alias("variance"), F.round("z", 4).alias("z"), F.round(two_sided(F.col("z")), 4).alias("p"))


GI = f"{NB}, g as {CELL}, nb0 as (select row, col, nv from nb union all select row, col, v from ok), s as (select row, col, count(*)::double w, sum(nv) s from nb0 group by 1, 2), gi as (select row, col, (s-mean*w)/(sd*sqrt(w*(n-w)/(n-1))) z from s, g)"


@query("stat45_gistar", f"with {GI} select row, col, round(z, 5) z from gi")
def gi(spark, d):
    return gi_star(grid(spark, d).select("row", "col", "v")).withColumn("z", F.round("z", 5))


def gi_class(z):
    a = F.abs(z)
    size = F.when(a >= Z99, "99").when(a >= Z95, "95").when(a >= Z90, "90")
    return F.when(size.isNull(), "ns").otherwise(F.concat(F.when(z > 0, "hot").otherwise("cold"), size))


@query("flt13_gi_class", f"with {GI} select row, col, case when abs(z) < {Z90} then 'ns' else case when z > 0 then 'hot' else 'cold' end || case when abs(z) >= {Z99} then '99' when abs(z) >= {Z95} then '95' else '90' end end gclass from gi")
def classified(spark, d):
    return gi_star(grid(spark, d).select("row", "col", "v")).select("row", "col", gi_class(F.col("z")).alias("gclass"))


@query("agg41_gi_summary", f"with {GI}, c as (select z, case when abs(z) < {Z90} then 'ns' when z > 0 then 'hot' else 'cold' end k from gi) select k, count(*) n, round(100e0*count(*)/sum(count(*)) over (), 6) pct, round(min(z), 5) lo, round(max(z), 5) hi from c group by 1")
def gi_summary(spark, d):
    c = gi_star(grid(spark, d).select("row", "col", "v")).withColumn("k", F.when(F.abs("z") < Z90, "ns").when(F.col("z") > 0, "hot").otherwise("cold")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("z"), 5).alias("lo"), F.round(F.max("z"), 5).alias("hi"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


BS = f"{NB}, okb as (select *, (row // 10) * 10 + col // 5 as block from ok), nbb as (select a.block, a.v, b.v nv from okb a join okb b on a.block = b.block and abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 and (a.row <> b.row or a.col <> b.col)), bs as (select * from (select block, count(*) n, sum(v) sx, sum(v*v) sxx from okb group by 1) left join (select block, count(*) w, sum(v*nv) xx, sum(v+nv) xs from nbb group by 1) using (block))"


def block_sums(spark, d):
    g = grid(spark, d).select("row", "col", "v", (F.floor(F.col("row") / 10) * 10 + F.floor(F.col("col") / 5)).cast("int").alias("block"))
    return moran_sums(g, QUEEN, ["block"])


@query("stat47_block_stats", f"with {BS} select block, n, round(sx, 2) sx, w, round(xx/1e6, 4) xx from bs")
def block_stats(spark, d):
    return block_sums(spark, d).select("block", "n", F.round("sx", 2).alias("sx"), "w", F.round(F.col("xx") / 1e6, 4).alias("xx"))


@query("stat48_block_moran", f"with {BS} select block, round(case when n >= 2 and w > 0 then n/w::double*(xx - sx/n*xs + sx/n*sx/n*w)/(sxx - sx*sx/n) end, 5) i from bs")
def block_moran(spark, d):
    return block_sums(spark, d).select("block", F.round(moran_from(*[F.col(c) for c in ("n", "sx", "sxx", "w", "xx", "xs")]), 5).alias("i"))


@query("stat49_moran_boot", f"with {BS}, {w_sql('', 19, 'select block from bs')}, r as (select rep, sum(t.w*n)::double n, sum(t.w*sx) sx, sum(t.w*sxx) sxx, sum(t.w*bs.w)::double w, sum(t.w*xx) xx, sum(t.w*xs) xs from bs join wt t using (block) group by 1), i as (select n/w*(xx - sx/n*xs + sx/n*sx/n*w)/(sxx - sx*sx/n) i from r) select round(quantile_cont(i, 0.025), 5) low, round(median(i), 5) median, round(quantile_cont(i, 0.975), 5) high, count(*) n from i")
def moran_boot(spark, d):
    bs = block_sums(spark, d).withColumnRenamed("w", "pairs")
    r = bs.join(weights(bs.select("block"), [], B, 19), "block").groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "sx", "sxx", "pairs", "xx", "xs")])
    i = r.select(moran_from(F.col("n"), F.col("sx"), F.col("sxx"), F.col("pairs"), F.col("xx"), F.col("xs")).alias("i"))
    return i.agg(*interval("i"), F.count("i").alias("n")).select(*[F.round(c, 5).alias(c) for c in ("low", "median", "high")], "n")


@query("agg49_block_metadata", f"with {BS} select count(*) candidates, count(*) filter (where n >= 20) usable, min(n) lo, max(n) hi, median(n)::double median, round(stddev_samp(n)/avg(n), 6) cv from bs")
def block_metadata(spark, d):
    return block_sums(spark, d).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("n") >= 20).alias("usable"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.median("n").alias("median"), F.round(F.stddev_samp("n") / F.avg("n"), 6).alias("cv"))


@query("stat44_moran_permutation", None)
def permutation(spark, d):
    """Plus-one p of 199 permutations: values are re-dealt among cells by keyed ranks, taken by ranges and not by one task a permutation."""
    from veldt.functions.scalars import draw

    g = grid(spark, d).filter("v is not null").select("row", "col", "v", F.lit(1).alias("one"))
    dealt = g.select("row", "col", "v", "one", F.explode(F.sequence(F.lit(1), F.lit(199))).alias("rep"))
    at = ranges.running_sum(ranges.by_ranges(g.withColumn("key", F.struct("row", "col")), [], "key"), [], "one", "k", "n").select("row", "col", "k")
    to = at.select("*", F.explode(F.sequence(F.lit(1), F.lit(199))).alias("rep"))
    drawn = dealt.withColumn("key", F.struct(draw("perm", F.col("rep"), F.col("row"), F.col("col")), "row", "col"))
    frm = ranges.running_sum(ranges.by_ranges(drawn, ["rep"], "key"), ["rep"], "one", "k", "n").select("rep", "k", "v")
    s = moran_sums(to.join(frm, ["rep", "k"]).select("rep", "row", "col", "v"), QUEEN, ["rep"])
    i = s.select(moran_from(*[F.col(c) for c in ("n", "sx", "sxx", "w", "xx", "xs")]).alias("ip"))
    obs = moran(spark, d).select("i", "n")
    e = -1 / (F.col("n") - 1)
    return i.join(F.broadcast(obs)).groupBy("i").agg(((1 + F.count_if(F.abs(F.col("ip") - e) >= F.abs(F.col("i") - e))) / (1 + F.count("ip"))).alias("p"))


@query("win12_focal", f"with {GRID} select a.row, a.col, count(b.v) n, round(avg(b.v), 4) mean from grid a join grid b on abs(a.row-b.row) <= 2 and abs(a.col-b.col) <= 2 group by 1, 2 having count(b.v) > 0")
def focal(spark, d):
    return focal_square(grid(spark, d).select("row", "col", "v"), 2).select("row", "col", "n", F.round("mean", 4).alias("mean"))


@query("win13_focal_cv", f"with {GRID} select a.row, a.col, round(stddev_pop(b.v)/avg(b.v), 6) cv from grid a join grid b on abs(a.row-b.row) <= 5 and abs(a.col-b.col) <= 5 group by 1, 2 having count(b.v) > 0")
def focal_cv(spark, d):
    return focal_square(grid(spark, d).select("row", "col", "v"), 5).select("row", "col", F.round(F.col("sd") / F.col("mean"), 6).alias("cv"))


@query("win14_focal_circle", f"with {GRID} select a.row, a.col, count(*) n, round(min(b.v), 4) lo, round(max(b.v), 4) hi, round(stddev_pop(b.v), 4) sd from grid a join grid b on (a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col) <= 4 where a.v is not null and b.v is not null group by 1, 2")
def focal_circle(spark, d):
    return neighbours(grid(spark, d).select("row", "col", "v"), (*circle(2), (0, 0))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("nv"), 4).alias("lo"), F.round(F.max("nv"), 4).alias("hi"), F.round(F.stddev_pop("nv"), 4).alias("sd"))


ENT = f"{GRID}, qz as (select row, col, least(7, floor(v/10000))::int bin from grid where v is not null)"


def binned(spark, d):
    return grid(spark, d).filter("v is not null").select("row", "col", F.least(F.lit(7), F.floor(F.col("v") / 10000)).cast("int").alias("v"))


@query("win16_focal_entropy", f"with {ENT}, c as (select a.row, a.col, b.bin, count(*)::double k from qz a join qz b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 group by 1, 2, 3), p as (select *, k/sum(k) over (partition by row, col) p from c) select row, col, round(-sum(p*ln(p)), 6) + 0.0 entropy from p group by 1, 2")
def entropy(spark, d):
    c = neighbours(binned(spark, d), (*QUEEN, (0, 0))).groupBy("row", "col", "nv").agg(F.count(F.lit(1)).cast("double").alias("k"))
    p = c.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("row", "col")))
    return p.groupBy("row", "col").agg((F.round(-F.sum(F.col("p") * F.log("p")), 6) + 0.0).alias("entropy"))


@query("win17_glcm", f"with {ENT}, pr as (select a.bin i, b.bin j, count(*)::double k from qz a join qz b on b.row = a.row and b.col = a.col + 1 group by 1, 2), p as (select i, j, k/sum(k) over () p from pr) select round(sum(p*(i-j)*(i-j)), 6) contrast, round(sum(p*abs(i-j)), 6) dissimilarity, round(sum(p/(1+(i-j)*(i-j))), 6) homogeneity, round(sum(p*p), 6) asm, round(-sum(p*ln(p)), 6) entropy from p")
def glcm(spark, d):
    p = neighbours(binned(spark, d), ((0, -1),)).groupBy(F.col("v").alias("i"), F.col("nv").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("k")).withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(F.lit(1))))
    dif = F.col("i") - F.col("j")
    s = lambda e, a: F.round(F.sum(e), 6).alias(a)
    return p.agg(s(F.col("p") * dif * dif, "contrast"), s(F.col("p") * F.abs(dif), "dissimilarity"), s(F.col("p") / (1 + dif * dif), "homogeneity"), s(F.col("p") * F.col("p"), "asm"), s(-F.col("p") * F.log("p"), "entropy"))


@query("win18_morphology", f"with {NB}, nb0 as (select row, col, v, nv from nb union all select row, col, v, v from ok) select row, col, round(max(nv), 4) dilation, round(min(nv), 4) erosion, round(max(nv)-min(nv), 4) gradient from nb0 group by 1, 2")
def morphology(spark, d):
    return neighbours(grid(spark, d).select("row", "col", "v"), (*QUEEN, (0, 0))).groupBy("row", "col").agg(F.round(F.max("nv"), 4).alias("dilation"), F.round(F.min("nv"), 4).alias("erosion"), F.round(F.max("nv") - F.min("nv"), 4).alias("gradient"))


HOT = "hot as (select p_size as row, month(l_shipdate)::int as col from lineitem join part on l_partkey = p_partkey group by 1, 2 having sum(l_partkey) % 5 < 2)"


def hot(spark, d):
    from veldt.sources.tables import table

    li, p = table(spark, d, "lineitem").select("l_partkey", "l_shipdate"), table(spark, d, "part").select("p_partkey", "p_size")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_size").alias("row"), F.month("l_shipdate").alias("col")).agg(F.sum("l_partkey").alias("s")).filter("s % 5 < 2").select("row", "col")


REACH = f"{HOT}, reach(row, col, r2, c2) as (select row, col, row, col from hot union select reach.row, reach.col, h.row, h.col from reach join hot h on abs(h.row-r2) <= 1 and abs(h.col-c2) <= 1), lab as (select row, col, min(r2*100+c2) m from reach group by 1, 2)"


@query("grf01_components", f"with recursive {REACH} select row, col, (m // 100)::bigint || '_' || (m % 100)::bigint patch from lab")
def components(spark, d):
    return patches(hot(spark, d))


@query("grf02_patch_sizes", f"with recursive {REACH} select (m // 100)::bigint || '_' || (m % 100)::bigint patch, count(*) n from lab group by 1")
def patch_sizes(spark, d):
    return patches(hot(spark, d)).groupBy("patch").agg(F.count(F.lit(1)).alias("n"))


@query("agg36_cluster_summary", f"with recursive {REACH}, {GRID} select (m // 100)::bigint || '_' || (m % 100)::bigint patch, count(*) n, round(sum(area), 2) area, round(median(v), 4) median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) iqr from lab join grid using (row, col) group by 1")
def cluster_summary(spark, d):
    j = patches(hot(spark, d)).join(grid(spark, d), ["row", "col"])
    return j.groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 2).alias("area"), F.round(F.median("v"), 4).alias("median"), F.round(F.percentile("v", 0.75) - F.percentile("v", 0.25), 4).alias("iqr"))


def scaled(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).select("row", "col", "v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("f"))
    f = F.col("f")
    return g.groupBy("f", F.floor((F.col("row") - 1) / f).cast("int").alias("row"), F.floor((F.col("col") - 1) / f).cast("int").alias("col")).agg(F.avg("v").alias("v"), F.count("v").alias("valid"), F.count(F.lit(1)).alias("possible"))


SC = f"{GRID}, sc as (select f, ((row-1)//f)::int as row, ((col-1)//f)::int as col, avg(v) v, count(v) valid, count(*) possible from grid, (select unnest([1, 2, 4]) f) group by all)"


@query("agg01_block_mean", f"with {SC} select f, row, col, round(v, 4) v, valid, possible from sc")
def block_mean(spark, d):
    return scaled(spark, d).withColumn("v", F.round("v", 4))


@query("agg02_partial_trim", f"with {SC} select f, row, col, round(case when valid >= greatest(1, ceil(0.5*f*f)) then v end, 4) v from sc where row < 50 // f and col < 12 // f")
def trimmed(spark, d):
    s = scaled(spark, d).filter("row < floor(50 / f) and col < floor(12 / f)")
    return s.select("f", "row", "col", F.round(F.when(F.col("valid") >= F.greatest(F.lit(1), F.ceil(0.5 * F.col("f") * F.col("f"))), F.col("v")), 4).alias("v"))


@query("flt08_valid_fraction", f"with {SC} select f, row, col, round(case when valid/possible::double >= 0.8 then v end, 4) v from sc")
def valid_fraction(spark, d):
    return scaled(spark, d).select("f", "row", "col", F.round(F.when(F.col("valid") / F.col("possible") >= 0.8, F.col("v")), 4).alias("v"))


@query("stat51_multiscale_moran", f"with {SC}, s as (select * from sc where v is not null), g as (select f, count(*)::double n, avg(v) mean, var_pop(v) vp from s group by 1), p as (select a.f, count(*)::double w, sum((a.v-mean)*(b.v-mean)) num from s a join s b on a.f = b.f and abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 and (a.row <> b.row or a.col <> b.col) join g on g.f = a.f group by 1) select f, n::bigint n, round(num/w/vp, 6) i from g join p using (f)")
def multiscale(spark, d):
    s = moran_sums(scaled(spark, d).select("f", "row", "col", "v"), QUEEN, ["f"])
    return s.select("f", "n", F.round(moran_from(*[F.col(c) for c in ("n", "sx", "sxx", "w", "xx", "xs")]), 6).alias("i"))


@query("agg03_overlap", f"with {GRID}, ov as (select floor((row-1+o)/2.5)::int as crow, v, least(floor((row-1)/2.5)*2.5+2.5, row) - (row-1) w0, o from grid, (select unnest([0.0, 0.999999])::double o) where v is not null), ws as (select crow, v, case when o = 0 then w0 else 1 - w0 end w from ov) select crow, round(sum(w*v)/sum(w), 4) v, round(sum(w), 6) support from ws where w > 1e-9 group by 1")
def overlap(spark, d):
    """Rows of height 1 on coarse rows of height 2.5: each fine cell gives to the one or two it overlaps."""
    g = grid(spark, d).filter("v is not null").withColumn("o", F.explode(F.array(F.lit(0.0), F.lit(0.999999))))
    w0 = F.least(F.floor((F.col("row") - 1) / 2.5) * 2.5 + 2.5, F.col("row").cast("double")) - (F.col("row") - 1)
    ws = g.select(F.floor((F.col("row") - 1 + F.col("o")) / 2.5).cast("int").alias("crow"), "v", F.when(F.col("o") == 0, w0).otherwise(1 - w0).alias("w")).filter("w > 1e-9")
    return ws.groupBy("crow").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 4).alias("v"), F.round(F.sum("w"), 6).alias("support"))


@query("snk05_cells_to_grid", f"with {GRID}, f as (select * from (select unnest(range(1, 51))::int as row), (select unnest(range(1, 13))::int as col)) select row, col, round(v, 4) v from f left join grid using (row, col)")
def to_grid(spark, d):
    full = spark.range(1, 51).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("col"))
    return full.join(grid(spark, d), ["row", "col"], "left").select("row", "col", F.round("v", 4).alias("v"))
