"""Grids of several bands: templates, samples at points, areas, geometries, spectral windows and texture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import raster
from veldt.queries import query
from veldt.sources.tables import table

BANDS = ["a", "b", "c"]
#: The scene's grid and the template's, in map units.
SCENE, TEMPLATE = raster.Geometry(0.0, 0.0, 4.0, 4.0), raster.Geometry(1.5, -0.5, 3.0, 5.0)
_scene = """scene as (select l_partkey // 20 as row, month(l_shipdate)::bigint as col, sum(l_quantity) a, sum(round(l_discount*100)) b, sum(round(l_tax*100)) c from lineitem
where not ((l_partkey // 20) % 11 = 3 and month(l_shipdate) % 4 = 1) group by 1, 2)"""
_templ = "templ as (select p_partkey // 25 as row, (p_size % 16)::bigint as col, sum(p_size % 3)::double v from part group by 1, 2)"


def scene(spark: SparkSession, d: str) -> DataFrame:
    """row, col and three bands: sums of the lines of twenty parts in a month; some cells are missing."""
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_partkey") / 20).alias("row"), F.month("l_shipdate").cast("long").alias("col"), "l_quantity", "l_discount", "l_tax")
    seen = li.filter(~((F.col("row") % 11 == 3) & (F.col("col") % 4 == 1)))
    return seen.groupBy("row", "col").agg(F.sum("l_quantity").alias("a"), F.sum(F.round(F.col("l_discount") * 100)).alias("b"), F.sum(F.round(F.col("l_tax") * 100)).alias("c"))


def template(spark: SparkSession, d: str) -> DataFrame:
    """row, col, v: places of parts; zero where every part's size is a multiple of three."""
    return table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 25).alias("row"), (F.col("p_size") % 16).cast("long").alias("col")).agg(F.sum(F.col("p_size") % 3).cast("double").alias("v"))


_at = "select row, col, (0.5e0 + (row + 0.5e0)*5)/4 y, (1.5e0 + (col + 0.5e0)*3)/4 x from templ where v <> 0"


@query("flt37_align_bilinear", f"""with {_scene}, {_templ}, t as (select row, col, y - 0.5e0 y, x - 0.5e0 x from ({_at})),
n as (select t.row, t.col, floor(y)::bigint + dr r, floor(x)::bigint + dc c, (case when dr = 1 then y - floor(y) else 1 - y + floor(y) end)*(case when dc = 1 then x - floor(x) else 1 - x + floor(x) end) w from t, (values (0), (1)) u(dr), (values (0), (1)) v(dc))
select n.row, n.col, {', '.join(f'round(sum(w*s.{b})/(sum(w) filter (where s.{b} is not null)), 6) {b}' for b in BANDS)} from n left join scene s on s.row = n.r and s.col = n.c where w > 0 group by 1, 2""")
def align_bilinear(spark, d):
    g = raster.align(scene(spark, d), SCENE, template(spark, d), TEMPLATE, BANDS)
    return g.select("row", "col", *[F.round(b, 6).alias(b) for b in BANDS])


@query("flt37_align_near", f"with {_scene}, {_templ}, t as ({_at}) select t.row, t.col, a, b, c from t left join scene s on s.row = floor(y)::bigint and s.col = floor(x)::bigint")
def align_near(spark, d):
    return raster.align(scene(spark, d), SCENE, template(spark, d), TEMPLATE, BANDS, method="near")


@query("join08_raster_sample", f"with {_scene}, p as (select o_orderkey, case when o_orderkey % 131 = 0 then null else (o_custkey % 97)*0.5 - 1 end::double x, (1 - o_orderkey/128.0)::double y from orders) select o_orderkey, a, b, c from p left join scene s on s.row = floor(-y/4)::bigint and s.col = floor(x/4)::bigint")
def raster_sample(spark, d):
    """The scene's bands at every order's place; null outside it and for orders without a place."""
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select("o_orderkey", F.when(k % 131 != 0, (F.col("o_custkey") % 97) * 0.5 - 1).alias("x"), (1 - k / 128.0).alias("y"))
    return raster.at_points(p, scene(spark, d), SCENE, BANDS).select("o_orderkey", *BANDS)


_e2 = raster.FLATTENING * (2 - raster.FLATTENING)
_e, _b = _e2**0.5, raster.RADIUS * (1 - raster.FLATTENING)
_upto = lambda lat: f"(sin(radians({lat}))/(1 - {_e2!r}*sin(radians({lat}))^2) + ln((1 + {_e!r}*sin(radians({lat})))/(1 - {_e!r}*sin(radians({lat}))))/(2*{_e!r}))"


@query("flt35_ellipsoid_area", f"with c as (select c_custkey, (c_custkey % 240)*0.5e0 - 60 south, 0.5e0*(1 + c_nationkey % 3) width, 30e0*(1 + c_nationkey % 3) size from customer) select c_custkey, round({_b!r}*{_b!r}/2*radians(width)*({_upto('(south + 0.5e0)')} - {_upto('south')})/1e6, 4) geodesic_km2, round(pow(size/1000, 2), 6) nominal_km2 from c")
def ellipsoid_area(spark, d):
    """Area of each customer's half degree cell on the ellipsoid, and the nominal area of a cell of so many metres."""
    k = 1 + F.col("c_nationkey") % 3
    south = (F.col("c_custkey") % 240) * 0.5 - 60
    return table(spark, d, "customer").select("c_custkey", F.round(raster.ellipsoid_area(south, south + 0.5, 0.5 * k), 4).alias("geodesic_km2"), F.round(F.pow(30.0 * k / 1000, F.lit(2.0)), 6).alias("nominal_km2"))


_grids = "g as (select s_suppkey, 30e0*(1 + s_suppkey % 3) a, (s_suppkey % 2)*-0.25e0 b, (s_suppkey % 4)*0.5e0 d, -(25e0 + s_nationkey) e, case s_nationkey % 4 when 0 then 'geographic' when 1 then null else 'projected' end kind, case s_nationkey % 4 when 2 then 1e0 when 3 then 0.3048e0 end metres from supplier)"


@query("flt29_resolution", f"with {_grids} select s_suppkey, round(sqrt(a*a + d*d), 6) size_x, round(sqrt(b*b + e*e), 6) size_y, round(abs(a*e - b*d), 6) cell_area, coalesce((kind = 'projected')::int, 0) is_projected, coalesce((kind = 'geographic')::int, 0) is_geographic, round(sqrt(a*a + d*d)*metres, 6) size_x_m, round(sqrt(b*b + e*e)*metres, 6) size_y_m from g")
def grid_resolution(spark, d):
    """What the cells of each supplier's (turned) grid measure, in map units and in metres where the units have a length."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey") % 4
    g = table(spark, d, "supplier").select("s_suppkey", (30.0 * (1 + k % 3)).alias("a"), ((k % 2) * -0.25).alias("b"), ((k % 4) * 0.5).alias("d"), (-(25.0 + F.col("s_nationkey"))).alias("e"), F.when(n == 0, "geographic").when(n > 1, "projected").alias("kind"), F.when(n == 2, 1.0).when(n == 3, 0.3048).alias("metres"))
    r = raster.resolution(g)
    return r.select("s_suppkey", "is_projected", "is_geographic", *[F.round(c, 6).alias(c) for c in ("size_x", "size_y", "cell_area", "size_x_m", "size_y_m")])


@query("flt21_geometry_faults", """with g as (select s_suppkey, case when s_suppkey % 13 = 0 then null else 'E' || s_nationkey // 20 end crs, 100 + (s_suppkey % 7 = 0)::int n_rows, 80 + (s_suppkey % 9 = 0)::int n_cols, 30.0 + (s_suppkey % 11 = 0)::int*1e-12 width, 30.0 + (s_suppkey % 10 = 0)::int w2, (s_suppkey % 8 = 0)::int*15.0 l, 0.0 t from supplier)
select s_suppkey, concat_ws(',', case when crs is distinct from 'E0' then 'system' end, case when n_rows <> 100 or n_cols <> 80 then 'shape' end, case when w2 <> 30 then 'size' end, case when l <> 0 then 'place' end) faults from g""")
def grid_faults(spark, d):
    """In what each supplier's grid differs from the first one's."""
    k = F.col("s_suppkey")
    off = lambda m: (k % m == 0).cast("int")
    g = table(spark, d, "supplier").select("s_suppkey", F.when(k % 13 != 0, F.concat(F.lit("E"), F.floor(F.col("s_nationkey") / 20))).alias("crs"), (100 + off(7)).alias("rows"), (80 + off(9)).alias("cols"), (30.0 + off(11) * 1e-12).alias("width"), (30.0 + off(10)).alias("height"), (off(8) * 15.0).alias("left"), F.lit(0.0).alias("top"))
    like = spark.range(1).select(F.lit("E0").alias("crs"), F.lit(100).alias("rows"), F.lit(80).alias("cols"), F.lit(30.0).alias("width"), F.lit(30.0).alias("height"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"))
    return raster.geometry_faults(g, like).select("s_suppkey", "faults")


_near = "select t.row, t.col, s.row - t.row dr, s.col - t.col dc, s.a, s.b, s.c from scene t join scene s on abs(s.row - t.row) <= {r} and abs(s.col - t.col) <= {r}"
_cos = "round(case when (a*a + b*b + c*c)*(ma*ma + mb*mb + mc*mc) > 0 then (a*ma + b*mb + c*mc)/sqrt((a*a + b*b + c*c)*(ma*ma + mb*mb + mc*mc)) else 0 end, 9)"


@query("win18_spectral_morphology", f"""with {_scene}, n as ({_near.format(r=1)}), m as (select *, avg(a) over w ma, avg(b) over w mb, avg(c) over w mc from n window w as (partition by row, col)),
k as (select *, row_number() over (partition by row, col order by {_cos}, dr, dc) far, row_number() over (partition by row, col order by {_cos} desc, dr, dc) near from m)
select row, col, {', '.join(f'max({b}) filter (where far = 1) {b}_dilation, max({b}) filter (where near = 1) {b}_erosion, max({b}) filter (where far = 1) - max({b}) filter (where near = 1) {b}_gradient' for b in BANDS)} from k group by 1, 2""")
def spectral_morphology(spark, d):
    return raster.spectral_morphology(scene(spark, d), BANDS)


@query("win15_spectral_spread", " union all ".join(f"select * from (with {_scene}, n as ({_near.format(r=r)}) select {r} as radius, row, col, round(sqrt((var_pop(a) + var_pop(b) + var_pop(c))/3), 5) sg, round(sqrt((pow(max(a) - min(a), 2) + pow(max(b) - min(b), 2) + pow(max(c) - min(c), 2))/3), 5) sd from n group by 2, 3)" for r in (1, 2, 3)))
def spectral_spread(spark, d):
    """Spread of the spectra in windows of three sizes."""
    s = scene(spark, d)
    parts = [raster.spectral_spread(s, BANDS, r).select(F.lit(r).alias("radius"), "row", "col", F.round("sg", 5).alias("sg"), F.round("sd", 5).alias("sd")) for r in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("win17_texture", f"""with {_scene}, g as (select row, col, floor(a/100)::bigint v from scene), d as (select * from (values (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) t(k, dr, dc)),
p as (select k, x.row r1, x.col c1, y.row r2, y.col c2, x.v i, y.v j from d, g x, g y where y.row = x.row + dr and y.col = x.col + dc), bw as (select * from p union all select k, r1, c1, r2, c2, j, i from p),
m as (select t.row, t.col, k, i::double i, j::double j, count(*)::double m from g t join bw on abs(r1 - t.row) <= 3 and abs(r2 - t.row) <= 3 and abs(c1 - t.col) <= 3 and abs(c2 - t.col) <= 3 group by all),
q as (select *, m/sum(m) over (partition by row, col, k) p from m),
e as (select row, col, k, sum(p*(i-j)^2) c, sum(p*abs(i-j)) ds, sum(p*p) a, -sum(p*ln(p)) en, sum(p*i*i) - sum(p*i)^2 var, sum(p*i*j) - sum(p*i)^2 cov from q group by 1, 2, 3)
select row, col, round(avg(c) + 1e-12, 9) contrast, round(avg(ds) + 1e-12, 9) dissimilarity, round(avg(a) + 1e-12, 9) asm, round(avg(en) + 1e-12, 9) entropy, round(avg(var) + 1e-12, 9) variance, round(avg(case when var > 1e-9 then cov/var end) + 1e-12, 9) correlation from e group by 1, 2""")
def texture(spark, d):
    """Six measures of co-occurrence in squares of seven cells around every cell; a hair is added so that halves round alike."""
    g = scene(spark, d).select("row", "col", F.floor(F.col("a") / 100).alias("v"))
    return raster.texture(g).select("row", "col", *[F.round(F.col(c) + 1e-12, 9).alias(c) for c in ("contrast", "dissimilarity", "asm", "entropy", "variance", "correlation")])
