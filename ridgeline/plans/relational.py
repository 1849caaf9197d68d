"""Queries on clipping, resampling, tiles, points, catalogues and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import style
from ridgeline.functions import tiles as tf
from ridgeline.grid import GridMeta, info_text
from ridgeline.operators import points as pt
from ridgeline.operators import extents, rasters, runs, tiles, warp
from ridgeline.plans import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _r(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)


_DEM = f"WITH {fx.DEM_SQL}"


@query(f"{_DEM}, m AS (SELECT max(r) + 1 AS n FROM dem) SELECT r - 2 AS r, c - 20 AS c, z FROM dem, m WHERE c >= 20 AND c < 60 AND r >= 2 AND r < n - 3")
def clip(spark, sf_dir: str) -> DataFrame:
    meta = fx.dem_meta(spark, sf_dir)
    return rasters.clip(fx.dem(spark, sf_dir), meta, 101.0, 15.0, 301.0, meta.y0 - 11.0)[0]


@query(f"{_DEM}, m AS (SELECT (max(r) + 1) // 4 AS n FROM dem) SELECT r // 4 AS r, c // 4 AS c, round(avg(z), 6) AS z FROM dem, m WHERE c < 148 AND r < n * 4 GROUP BY r // 4, c // 4")
def block_resample(spark, sf_dir: str) -> DataFrame:
    out, _ = rasters.resample(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir), target=20.0)
    return out.select("r", "c", _r("z").alias("z"))


@query(
    f"""{_DEM}, m AS (SELECT max(r) + 1 AS n, round_even((max(r) + 1) / 1.5::DOUBLE, 0)::INTEGER AS nr FROM dem),
tr AS (SELECT t AS r, t * ((n - 1)::DOUBLE / (nr - 1)) AS f FROM m, range(0, nr) s(t)), tc AS (SELECT t AS c, t * (149::DOUBLE / 99) AS f FROM range(0, 100) s(t)),
p AS (SELECT tr.r, tc.c, greatest(0, 1 - abs(tr.f - d.r)) * greatest(0, 1 - abs(tc.f - d.c)) AS w, d.z FROM tr JOIN dem d ON abs(tr.f - d.r) < 1 JOIN tc ON abs(tc.f - d.c) < 1)
SELECT r::INTEGER AS r, c::INTEGER AS c, round(CASE WHEN sum(CASE WHEN z IS NULL THEN w ELSE 0 END) <= 0.5 THEN sum(w * coalesce(z, 0.0)) END, 5) AS z FROM p GROUP BY r, c"""
)
def bilinear_resample(spark, sf_dir: str) -> DataFrame:
    out, _ = rasters.resample(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir), target=7.5)
    return out.select("r", "c", _r("z", 5).alias("z"))


@query("""WITH s AS (SELECT (o_orderkey // 3 // 100)::INTEGER AS r, (o_orderkey // 3 % 100)::INTEGER AS c, (o_orderkey % 3)::INTEGER AS ord, CASE WHEN o_custkey % 4 <> 1 THEN o_totalprice END AS z FROM orders)
SELECT r, c, arg_max(z, CASE WHEN z IS NOT NULL THEN ord END) AS z FROM s GROUP BY r, c""")
def mosaic_last(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = F.floor(k / 3)
    sources = fx.table(spark, sf_dir, "orders").select(F.floor(cell / 100).cast("int").alias("r"), (cell % 100).cast("int").alias("c"), (k % 3).cast("int").alias("src_ord"), F.when(F.col("o_custkey") % 4 != 1, F.col("o_totalprice")).alias("z"))
    return rasters.mosaic(sources)


@query("""WITH s AS (SELECT (o_orderkey // 3 // 100)::INTEGER AS r, (o_orderkey // 3 % 100)::INTEGER AS c, (o_orderkey % 3)::INTEGER AS priority, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS z FROM orders),
b AS (SELECT min(priority) AS priority FROM s WHERE z IS NOT NULL) SELECT r, c, s.priority, z FROM s JOIN b ON b.priority = s.priority""")
def first_usable_source(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = F.floor(k / 3)
    sources = fx.table(spark, sf_dir, "orders").select(F.floor(cell / 100).cast("int").alias("r"), (cell % 100).cast("int").alias("c"), (k % 3).cast("int").alias("priority"), F.when(k % 3 > 0, F.col("o_totalprice")).alias("z"))
    return rasters.first_usable(sources).select("r", "c", "priority", "z")


@query(f"{_DEM}, m AS (SELECT max(r) + 1 AS n FROM dem), p AS (SELECT l_orderkey AS k, l_linenumber AS l, l_partkey % 800 - 4.0::DOUBLE + l_discount AS x, l_suppkey * 3 % 60 + l_tax AS y, l_extendedprice AS e FROM lineitem)\nSELECT k, l, e, z FROM p CROSS JOIN m LEFT JOIN dem ON dem.c = trunc(x / 5.0)::INTEGER AND dem.r = trunc((y - n * 5.0) / -5.0)::INTEGER")
def sample_points(spark, sf_dir: str) -> DataFrame:
    x = F.col("l_partkey") % 800 - F.lit(4.0) + F.col("l_discount")
    y = F.col("l_suppkey") * 3 % 60 + F.col("l_tax")
    points = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_extendedprice").alias("e"), x.alias("x"), y.alias("y"))
    return rasters.sample_points(points, fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir)).select("k", "l", "e", "z")


_HALF = 20037508.342789244


@query(
    f"""{_DEM}, p AS (SELECT l_orderkey AS k, l_linenumber AS l, l_extendedprice AS e, (15551000 + l_partkey % 800 - 4.0::DOUBLE + l_discount + 0.013) / {_HALF}::DOUBLE * 180 AS lon, degrees(atan(sinh((4244000 - (l_suppkey * 3 % 600 + l_tax + 0.013)) / {_HALF}::DOUBLE * pi()))) AS lat FROM lineitem),
q AS (SELECT k, l, e, (lon / 180 * {_HALF}::DOUBLE - 15551000) / 5 AS fc, (ln(tan(radians(45 + lat / 2))) / pi() * {_HALF}::DOUBLE - 4244000) / -5 AS fr FROM p)
SELECT k, l, e, z FROM q LEFT JOIN dem ON dem.c = trunc(fc)::INTEGER AND dem.r = trunc(fr)::INTEGER"""
)
def sample_points_lonlat(spark, sf_dir: str) -> DataFrame:
    """Points in degrees on a grid in Web Mercator."""
    meta = GridMeta(fx.dem_meta(spark, sf_dir).rows, fx.COLS, 5.0, 15551000.0, 4244000.0, 5.0, -5.0, 3857)
    x = F.lit(15551000) + F.col("l_partkey") % 800 - F.lit(4.0) + F.col("l_discount") + 0.013
    y = F.lit(4244000) - (F.col("l_suppkey") * 3 % 600 + F.col("l_tax") + 0.013)
    lon, lat = rasters.mercator_lonlat(x, y)
    points = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_extendedprice").alias("e"), lon.alias("x"), lat.alias("y"))
    return rasters.sample_points(points, fx.dem(spark, sf_dir), meta, epsg=4326).select("k", "l", "e", "z")


@query(f"{_DEM} SELECT round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std, count(z) AS n FROM dem")
def band_stats(spark, sf_dir: str) -> DataFrame:
    out = rasters.band_statistics(fx.dem(spark, sf_dir))
    return out.select(*[_r(k).alias(k) for k in ("min", "max", "mean", "std")], "n")


@query("WITH g AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE * 100 AS z FROM embeddings) SELECT c::INTEGER AS c, round(min(z), 5) AS min, round(max(z), 5) AS max, round(avg(z), 5) AS mean, count(*) AS n FROM g GROUP BY c")
def array_raster(spark, sf_dir: str) -> DataFrame:
    """Arrays as rows of a raster; statistics of its columns."""
    cells = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "v"))
    z = F.col("v").cast("double") * 100
    return cells.groupBy("c").agg(_r(F.min(z), 5).alias("min"), _r(F.max(z), 5).alias("max"), _r(F.avg(z), 5).alias("mean"), F.count("*").alias("n"))


_EXTENTS = "ext AS (SELECT p_partkey AS k, (p_partkey % 50) * 10.0::DOUBLE AS xmin, (p_partkey % 37) * 9.0::DOUBLE AS ymin, (p_partkey % 50) * 10.0::DOUBLE + p_size AS xmax, (p_partkey % 37) * 9.0::DOUBLE + p_size * 2 AS ymax FROM part)"


def _extents(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 50) * F.lit(10.0), (k % 37) * F.lit(9.0)
    return fx.table(spark, sf_dir, "part").select(k.alias("k"), x.alias("xmin"), y.alias("ymin"), (x + F.col("p_size")).alias("xmax"), (y + F.col("p_size") * 2).alias("ymax"))


@query(f"WITH {_EXTENTS} SELECT k, NOT (xmax < 120 OR xmin > 260 OR ymax < 90 OR ymin > 200) AS hit, xmin < 110 OR ymin < 80 OR xmax > 270 OR ymax > 210 AS outside FROM ext")
def bbox_overlap(spark, sf_dir: str) -> DataFrame:
    a = tuple(F.col(n) for n in ("xmin", "ymin", "xmax", "ymax"))
    view = tuple(F.lit(v) for v in (120.0, 90.0, 260.0, 200.0))
    around = GridMeta(22, 28, 5.0, 120.0, 200.0, 5.0, -5.0)
    return _extents(spark, sf_dir).select("k", rasters.overlaps(a, view).alias("hit"), rasters.outside_by_pixels(a, around).alias("outside"))


_VIEWS = "views AS (SELECT s_suppkey AS v, (s_suppkey * 37 % 500)::DOUBLE AS xmin, (s_suppkey * 53 % 330)::DOUBLE AS ymin, s_suppkey * 37 % 500 + pow(2.0, s_suppkey % 9) AS xmax, s_suppkey * 53 % 330 + pow(2.0, s_suppkey % 7) AS ymax FROM supplier)"


@query(f"WITH {_EXTENTS}, {_VIEWS} SELECT k, v FROM ext e JOIN views w ON NOT (e.xmax < w.xmin OR e.xmin > w.xmax OR e.ymax < w.ymin OR e.ymin > w.ymax)")
def extent_overlap_join(spark, sf_dir: str) -> DataFrame:
    """Extents against views of 1 to 256 units across: the pairs that touch."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 500).cast("double"), (k * 53 % 330).cast("double")
    views = fx.table(spark, sf_dir, "supplier").select(k.alias("v"), x.alias("xmin"), y.alias("ymin"), (x + F.pow(F.lit(2.0), k % 9)).alias("xmax"), (y + F.pow(F.lit(2.0), k % 7)).alias("ymax"))
    return extents.overlap_join(_extents(spark, sf_dir), views).select("k", "v")


@query(f"WITH {_EXTENTS} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM ext")
def extent_union(spark, sf_dir: str) -> DataFrame:
    return rasters.extent_union(_extents(spark, sf_dir))


@query(f"WITH {_EXTENTS}, a AS (SELECT k, (xmax - xmin) * (ymax - ymin) / 10000.0 AS ha, ((xmax - xmin) / 1e5 * 111320 * cos(radians((ymin + ymax) / 2e5))) * ((ymax - ymin) / 1e5 * 111320) / 10000.0 AS geo FROM ext)\nSELECT k, round(ha, 6) AS ha, round(geo, 6) AS geographic_ha, CASE WHEN ha * 300 >= 100 THEN printf('%.0f ha', ha * 300 + 1e-7) WHEN ha * 300 >= 1 THEN printf('%.1f ha', ha * 300 + 1e-7) ELSE printf('%.2f ha', ha * 300 + 1e-7) END AS text FROM a")
def area_ha(spark, sf_dir: str) -> DataFrame:
    e = [F.col(n) for n in ("xmin", "ymin", "xmax", "ymax")]
    ha = rasters.area_hectares(*e)
    return _extents(spark, sf_dir).select("k", _r(ha).alias("ha"), _r(rasters.area_hectares(*[x / 1e5 for x in e], geographic=True)).alias("geographic_ha"), rasters.area_text(ha * 300 + 1e-7).alias("text"))


_PLACES = "p AS (SELECT c_custkey AS k, (c_custkey % 359 - 180 + 0.123)::DOUBLE AS lon, (c_custkey * 7 % 160 - 80 + 0.456)::DOUBLE AS lat FROM customer)"


def _places(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(k.alias("k"), (k % 359 - 180 + F.lit(0.123)).alias("lon"), (k * 7 % 160 - 80 + F.lit(0.456)).alias("lat"))


@query(f"WITH {_PLACES} SELECT k, (floor((lon + 180) / 6)::INTEGER + 1 + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END)::INTEGER AS epsg FROM p")
def utm_epsg(spark, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("k", rasters.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"WITH {_PLACES} SELECT k, trunc((lon + 180) / 360 * 32768)::BIGINT AS tx, trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768)::BIGINT AS ty FROM p")
def lonlat_to_tile(spark, sf_dir: str) -> DataFrame:
    x, y = tf.tile_of(F.col("lon"), F.col("lat"), 15)
    return _places(spark, sf_dir).select("k", x.alias("tx"), y.alias("ty"))


@query("WITH q AS (SELECT c_custkey AS k, c_custkey * 31 % 16384 AS tx, c_custkey * 17 % 16384 AS ty FROM customer) SELECT k, round(tx / 16384.0 * 360 - 180, 6) AS lon, round(degrees(atan((exp(pi() * (1 - 2 * ty / 16384.0)) - exp(-pi() * (1 - 2 * ty / 16384.0))) / 2)), 6) AS lat,\nround(-20037508.3428::DOUBLE + tx * (2 * 20037508.3428::DOUBLE / 16384), 4) AS x0, round(20037508.3428::DOUBLE - ty * (2 * 20037508.3428::DOUBLE / 16384), 4) AS y0, round(2 * 20037508.3428::DOUBLE / 16384 / 256, 6) AS px FROM q")
def tile_to_lonlat(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tx, ty = k * 31 % 16384, k * 17 % 16384
    lon, lat = tf.tile_corner(tx, ty, 14)
    x0, y0, px = tf.tile_transform(tx, ty, 14)
    return fx.table(spark, sf_dir, "customer").select(k.alias("k"), _r(lon).alias("lon"), _r(lat).alias("lat"), _r(x0, 4).alias("x0"), _r(y0, 4).alias("y0"), _r(px).alias("px"))


_PIXELS = "px AS (SELECT o_orderkey AS k, o_orderkey * 7 % 256 AS r, o_orderkey * 13 % 256 AS g, o_orderkey * 29 % 256 AS b FROM orders UNION ALL SELECT -1, 128, 0, 0)"


def _pixels(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").select(k.alias("k"), (k * 7 % 256).alias("r"), (k * 13 % 256).alias("g"), (k * 29 % 256).alias("b"))
    return rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(128).cast("long").alias("r"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("b")))


@query(f"WITH {_PIXELS}, u AS (SELECT k, r * 65536 + g * 256 + b AS u FROM px) SELECT k, round(CASE WHEN u < 8388608 THEN u * 0.01::DOUBLE WHEN u > 8388608 THEN (u - 16777216) * 0.01::DOUBLE END, 4) AS z FROM u")
def rgb_decode_gsi(spark, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("k", _r(tf.decode_gsi(F.col("r"), F.col("g"), F.col("b")), 4).alias("z"))


@query(f"WITH {_PIXELS} SELECT k, round(r * 256.0::DOUBLE + g + b / 256.0::DOUBLE - 32768, 6) AS z FROM px")
def rgb_decode_terrarium(spark, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("k", _r(tf.decode_terrarium(F.col("r"), F.col("g"), F.col("b"))).alias("z"))


@query("WITH t AS (SELECT o_orderkey % 4 AS tx, o_orderkey // 4 % 3 AS ty, o_orderkey // 12 % 256 AS px, o_orderkey // 3072 % 256 AS py, o_totalprice AS z FROM orders) SELECT ((ty - 1) * 256 + py)::INTEGER AS r, ((tx - 1) * 256 + px)::INTEGER AS c, z FROM t WHERE tx BETWEEN 1 AND 2 AND ty BETWEEN 1 AND 2")
def tile_mosaic(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pixels = fx.table(spark, sf_dir, "orders").select((k % 4).alias("tx"), (F.floor(k / 4) % 3).alias("ty"), (F.floor(k / 12) % 256).alias("px"), (F.floor(k / 3072) % 256).alias("py"), F.col("o_totalprice").alias("z"))
    return tiles.tile_pixels(pixels, 1, 1, 2, 2)


_BOX = "b AS (SELECT k, code, (ascii(substr(code, 4, 1)) - 69) * 40000 + substr(code, 6, 1)::INTEGER * 4000 + substr(code, 8, 1)::INTEGER * 400 AS xmin, -(ascii(substr(code, 3, 1)) - 77 + 2) * 30000 - substr(code, 5, 1)::INTEGER * 3000 - substr(code, 7, 1)::INTEGER * 300 AS ymax FROM codes)"


@query(f"WITH {fx.CODES_SQL}, {_BOX} SELECT k, code, xmin, ymax - 300 AS ymin, xmin + 400 AS xmax, ymax FROM b")
def tile_bbox(spark, sf_dir: str) -> DataFrame:
    box = tf.code_extent(F.col("code"))
    return fx.codes(spark, sf_dir).select("k", "code", *[v.alias(n) for v, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)])


@query(
    f"""WITH {fx.CODES_SQL}, {_BOX}, e AS (SELECT k, xmin - 150.0 AS xmin, ymax - 380.0 AS ymin, xmin + 500.0 AS xmax, ymax + 20.0 AS ymax FROM b),
f AS (SELECT substr('LMNOP', i, 1) || substr('BCDEF', j, 1) AS folder, (j + 65 - 69) * 40000 AS x0, -(i + 75 - 77 + 2) * 30000 AS y0 FROM range(1, 6) a(i), range(1, 6) q(j)),
s AS (SELECT e.*, folder, x0, y0, xc, yr FROM e JOIN f ON xmax >= x0 AND xmin <= x0 + 40000 AND ymax >= y0 - 30000 AND ymin <= y0, range(0, 10) a(xc), range(0, 10) c(yr)
  WHERE xc BETWEEN trunc((xmin - x0) / 4000.0) AND trunc((xmax - x0) / 4000.0) AND yr BETWEEN trunc((y0 - ymax) / 3000.0) AND trunc((y0 - ymin) / 3000.0)),
t AS (SELECT *, x0 + xc * 4000 AS bx, y0 - yr * 3000 AS ty0 FROM s),
a AS (SELECT k, xmin, ymin, xmax, ymax, folder, yr * 10 + xc AS xx, ar * 10 + ac AS aa FROM t, range(0, 10) p(ac), range(0, 10) q(ar)
  WHERE ac BETWEEN trunc((xmin - bx) / 400.0) AND trunc((xmax - bx) / 400.0) AND ar BETWEEN trunc((ty0 - ymax) / 300.0) AND trunc((ty0 - ymin) / 300.0)
  UNION SELECT k, xmin, ymin, xmax, ymax, folder, yr * 10 + xc, ((gr // 2) * 2 + gc // 2 + 1) * 10 + (gr % 2) * 2 + gc % 2 + 1 FROM t, range(0, 4) p(gc), range(0, 4) q(gr)
  WHERE gc BETWEEN trunc((xmin - bx) / 1000.0) AND trunc((xmax - bx) / 1000.0) AND gr BETWEEN trunc((ty0 - ymax) / 750.0) AND trunc((ty0 - ymin) / 750.0)),
n AS (SELECT *, (ascii(substr(folder, 2, 1)) - 69) * 40000 + xx % 10 * 4000 + aa % 10 * 400 AS tx, -(ascii(substr(folder, 1, 1)) - 77 + 2) * 30000 - xx // 10 * 3000 - aa // 10 * 300 AS ty FROM a)
SELECT DISTINCT k AS ext_id, '08' || folder || lpad(xx::VARCHAR, 2, '0') || lpad(aa::VARCHAR, 2, '0') AS code FROM n WHERE tx + 400 > xmin AND tx < xmax AND ty > ymin AND ty - 300 < ymax"""
)
def tiles_for_extent(spark, sf_dir: str) -> DataFrame:
    box = tf.code_extent(F.col("code"))
    x, y = box[0], box[3]
    at = fx.codes(spark, sf_dir).select(F.col("k").alias("ext_id"), (x - 150.0).alias("xmin"), (y - 380.0).alias("ymin"), (x + 500.0).alias("xmax"), (y + 20.0).alias("ymax"))
    return tiles.tiles_for_extents(at)


@query(f"WITH {fx.CATALOG_SQL} SELECT code, max(year) AS year FROM catalog WHERE lp_type = 'Grid' GROUP BY code")
def resolve_years(spark, sf_dir: str) -> DataFrame:
    return tiles.resolve_years(fx.codes(spark, sf_dir), fx.catalog(spark, sf_dir))


@query(f"WITH {fx.CATALOG_SQL}, o AS (SELECT code, max(year) AS year FROM catalog WHERE lp_type = 'Original' GROUP BY code) SELECT code, year, 'Original' AS lp_type FROM o UNION ALL SELECT code, max(year), 'Ground' FROM catalog WHERE lp_type = 'Ground' AND code NOT IN (SELECT code FROM o) GROUP BY code")
def original_else_ground(spark, sf_dir: str) -> DataFrame:
    return tiles.original_else_ground(fx.codes(spark, sf_dir), fx.catalog(spark, sf_dir))


@query("SELECT 'dem/' || p_partkey || '.tif' AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey <> 3")
def cache_gc(spark, sf_dir: str) -> DataFrame:
    path = lambda k: F.concat(F.lit("dem/"), F.col(k).cast("string"), F.lit(".tif"))
    files = fx.table(spark, sf_dir, "part").select(path("p_partkey").alias("path"))
    used = fx.table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(path("l_partkey").alias("dem_path"))
    return tiles.unreferenced(files, used, "dem/3.tif")


_CLOUD = "p AS (SELECT (l_partkey % 100)::DOUBLE + l_discount AS x, l_suppkey::DOUBLE + l_tax AS y, l_quantity::FLOAT AS z FROM lineitem), b AS (SELECT min(x) AS x0, min(y) AS y0, ceil((max(y) - min(y)) / 0.5)::INTEGER + 1 AS nr FROM p)"


@query(f"WITH {_CLOUD} SELECT (nr - 1 - floor((y - y0) / 0.5)::INTEGER)::INTEGER AS r, floor((x - x0) / 0.5)::INTEGER AS c, max(z) AS z FROM p, b GROUP BY 1, 2")
def dsm_max_grid(spark, sf_dir: str) -> DataFrame:
    cloud = fx.cloud(spark, sf_dir)
    meta = pt.surface_meta(cloud)
    return pt.highest(cloud, meta, cloud.agg(F.min("y")).first()[0])


@query("""WITH k AS (SELECT o_orderkey AS k, o_custkey % 2 AS file, (o_orderkey // 2) % 900 AS cell, (floor(o_totalprice)::INTEGER % 1000) / 10.0::DOUBLE AS z FROM orders WHERE o_orderkey % 50 <> 7),
b AS (SELECT file, max(cell // 30) AS top, min(cell % 30) AS low FROM k GROUP BY file)
SELECT ('f' || k.file) AS file, (top - cell // 30)::INTEGER AS r, (cell % 30 - low)::INTEGER AS c, arg_max(z, k)::FLOAT::DOUBLE AS z FROM k JOIN b ON b.file = k.file GROUP BY k.file, top, low, cell""")
def xyz_grid_last(spark, sf_dir: str) -> DataFrame:
    """Two texts of points, one of each layout, with broken lines; the last line of a cell wins."""
    k, cell = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2) % 900
    x, y = (cell % 30) * F.lit(0.5) + 0.25, F.floor(cell / 30) * F.lit(0.5) + 0.25
    z = F.expr("CAST(floor(o_totalprice) AS INT) % 1000 / 10.0D")
    parts = [v.cast("string") for v in (x, y, z)]
    line = F.when(k % 50 == 7, "broken line here now").when(F.col("o_custkey") % 2 == 0, F.concat_ws(" ", *parts)).otherwise(F.concat(k.cast("string"), F.lit(","), F.concat_ws(",", *parts), F.lit(",1")))
    lines = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 2).cast("string")).alias("file"), k.alias("line_no"), line.alias("line"))
    return pt.latest_of_files(pt.parse_xyz(lines))[0].select("file", "r", "c", F.col("z").cast("double").alias("z"))


_RUNS = "n AS (SELECT o_orderkey AS k, o_orderkey % 999 + 1 AS seq, o_custkey % 25 AS files FROM orders), names AS (SELECT k, seq, files, CASE WHEN files <= 9 THEN lpad(seq::VARCHAR, 3, '0') || files ELSE lpad(seq::VARCHAR, 3, '0') || '0+' || (files - 10) END AS name FROM n)"


def _runs(spark, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 999 + 1).alias("number"), (F.col("o_custkey") % 25).alias("n_files"))
    return rows.withColumn("name", runs.run_name(F.col("number"), F.col("n_files")))


@query(f"WITH {_RUNS} SELECT k, name FROM names")
def run_number(spark, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("k", "name")


@query(f"WITH {_RUNS} SELECT k, name, seq::INTEGER AS seq, files::INTEGER AS files, row_number() OVER (PARTITION BY seq ORDER BY files, k) AS place FROM names WHERE k % 13 <> 1")
def run_sort(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    names = _runs(spark, sf_dir).withColumn("name", F.when(F.col("k") % 13 == 1, F.concat(F.col("name"), F.lit("x"))).otherwise(F.col("name")))
    place = F.row_number().over(Window.partitionBy("seq").orderBy("files", "k"))
    return runs.sorted_runs(names).select("k", "name", "seq", "files", place.cast("long").alias("place"))


@query(f"WITH {_RUNS} SELECT printf('%03d', max(seq) + 1) AS seq FROM names")
def next_sequence(spark, sf_dir: str) -> DataFrame:
    return runs.next_sequence(_runs(spark, sf_dir))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'No condition data (legacy run)' WHEN o_orderkey % 7 = 1 THEN 'No conditions'
WHEN o_orderkey % 7 = 2 THEN 'Valley: TWI≥8.0 · min area - m²' ELSE 'Flow: ' || (o_custkey % 9 + 1) || '.0h · 50.0mm/h · total 100.0mm' || chr(10) || 'Stability: φ35.0° · C=0.0kPa · z=1.0m · m=0.5' END AS text FROM orders""")
def condition_text(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    full = F.concat(F.lit('{"analyses": ["flow", "stability"], "duration_h": '), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit('.0, "rainfall_mmh": 50.0, "total_mm": 100.0, "phi_deg": 35.0, "c_kpa": 0.0, "z_m": 1.0, "m_sat": 0.5}'))
    text = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, '{"analyses": []}').when(k % 7 == 2, '{"analyses": ["valley"], "twi_thresh": 8.0}').otherwise(full)
    return fx.table(spark, sf_dir, "orders").select(k.alias("k"), text.alias("json")).select("k", runs.condition_text("json").alias("text"))


@query("SELECT c_custkey AS k, printf('%d x %d px | %.2f m/px | EPSG:%d', c_custkey % 900 + 1, c_custkey % 700 + 1, c_custkey % 11 / 2.0 + 0.5, 32600 + c_custkey % 60 + 1) AS info FROM customer")
def grid_info(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(k.alias("k"), info_text(k % 900 + 1, k % 700 + 1, k % 11 / 2.0 + 0.5, 32600 + k % 60 + 1).alias("info"))


@query("""WITH s AS (SELECT o_orderkey % 3 AS f, (o_orderkey // 3 // 100)::INTEGER AS r, (o_orderkey // 3 % 100)::INTEGER AS c, CASE WHEN o_custkey % 4 <> 1 THEN o_totalprice END AS z FROM orders),
t AS (SELECT f, (r + f * 7)::INTEGER AS r, (c + f * 40)::INTEGER AS c, z FROM s) SELECT r, c, arg_max(z, CASE WHEN z IS NOT NULL THEN f END) AS z FROM t GROUP BY r, c""")
def mosaic_rebased(spark, sf_dir: str) -> DataFrame:
    """Three files that lie 40 columns and 7 rows apart, on the grid over all of them."""
    k = F.col("o_orderkey")
    cell, name = F.floor(k / 3), F.concat(F.lit("f"), (k % 3).cast("string"))
    cells = fx.table(spark, sf_dir, "orders").select(name.alias("path"), F.floor(cell / 100).cast("int").alias("r"), (cell % 100).cast("int").alias("c"), F.when(F.col("o_custkey") % 4 != 1, F.col("o_totalprice")).alias("z"))
    f = F.substring("path", 2, 1).cast("int")
    x0, y0 = f * 20.0 + 500.0, 9000.0 - f * 3.5
    sizes = cells.groupBy("path").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    catalogue = sizes.select("path", "rows", "cols", F.lit(0.5).alias("cell"), F.lit(6676).alias("epsg"), x0.alias("x0"), y0.alias("y0"), F.lit(0.5).alias("px"), F.lit(-0.5).alias("py"), x0.alias("xmin"), (y0 - F.col("rows") * 0.5).alias("ymin"), (x0 + F.col("cols") * 0.5).alias("xmax"), y0.alias("ymax"))
    return rasters.merge(cells, catalogue)[0]


@query(f"{_DEM}, m AS (SELECT (max(r) + 1) // 5 AS n FROM dem) SELECT r // 5 AS r, c // 5 AS c, round(avg(z), 6) AS z FROM dem, m WHERE r < n * 5 GROUP BY r // 5, c // 5")
def auto_resample(spark, sf_dir: str) -> DataFrame:
    """A grid of 0.1 m becomes one of 0.5 m."""
    out, _ = rasters.auto_resample(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir).with_cell(0.1))
    return out.select("r", "c", _r("z").alias("z"))


@query("SELECT 'las/' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.las' ELSE '_dsm.tif' END AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def stale_surfaces(spark, sf_dir: str) -> DataFrame:
    """Point clouds and surfaces that no stored run refers to."""
    path = lambda k: F.concat(F.lit("las/"), F.col(k).cast("string"), F.when(F.col(k) % 2 == 0, ".las").otherwise("_dsm.tif"))
    files = fx.table(spark, sf_dir, "customer").select(path("c_custkey").alias("path"))
    used = fx.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(path("o_custkey").alias("dem_path"))
    return tiles.unreferenced(files, used)


@query(f"WITH {fx.CATALOG_SQL}, y AS (SELECT code, max(year) AS year FROM catalog WHERE lp_type = 'Grid' GROUP BY code), t AS (SELECT count(*) AS tiles, (SELECT string_agg(year::VARCHAR, ', ' ORDER BY year) FROM (SELECT DISTINCT year FROM y)) AS years FROM y) SELECT tiles, years, tiles || ' tile(s), year(s): ' || years AS text FROM t")
def years_summary(spark, sf_dir: str) -> DataFrame:
    return tiles.years_summary(tiles.resolve_years(fx.codes(spark, sf_dir), fx.catalog(spark, sf_dir)))


@query("SELECT event_id AS k, 'twi_' || strftime(ts, '%Y%m%d_%H%M%S') || '.tif' AS name FROM events")
def stamped_names(spark, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), runs.stamped_name(F.lit("twi"), F.lit(".tif"), F.col("ts")).alias("name"))


@query("SELECT o_orderkey AS k, (o_orderkey % 5 + 1)::INTEGER AS n FROM orders")
def counted_layers(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    layers = F.concat(F.array(F.lit("slope"), F.lit("shc")), F.slice(F.array(*[F.lit(x) for x in ("twi", "tc", "flow_peak", "flow_mean", "stability_fs")]), F.lit(1), (k % 5 + 1).cast("int")))
    return fx.table(spark, sf_dir, "orders").select(k.alias("k"), runs.counted(layers).alias("n"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 9 + 1)::DOUBLE END AS duration_h, CASE WHEN o_orderkey % 4 > 0 THEN 2 ELSE 1 END::INTEGER AS analyses, CASE WHEN o_orderkey % 4 = 0 THEN 8.5::DOUBLE END AS twi_thresh FROM orders")
def parse_manifest(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, '{"analyses": ["valley"], "twi_thresh": 8.5}').otherwise(F.concat(F.lit('{"analyses": ["flow", "stability"], "duration_h": '), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit(".0}")))
    p = runs.parse_manifest(text)
    return fx.table(spark, sf_dir, "orders").select(k.alias("k"), p["duration_h"].alias("duration_h"), F.size(p["analyses"]).alias("analyses"), p["twi_thresh"].alias("twi_thresh"))


_LAYERS = ", ".join(f"('{a}', '{n}', '{t}', '{k}', '{s}', {style.RANK[a]})" for a, n, t, k, s in style.LAYERS)
_FILLS = ", ".join(f"('{n}', {f[0]}, {f[1]}, {f[2]}, {f[3]})" for n, (f, _) in style.ZONES.items())
_STORED = "s AS (SELECT o_orderkey AS k, (['stability_fs', 'valley_zones', 'twi', 'slope', 'flow_vtotal', 'integrated_high_risk', 'unstable_zones'])[(o_orderkey % 7 + 1)::INTEGER] AS layer FROM orders)"


def _stored(spark, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("stability_fs", "valley_zones", "twi", "slope", "flow_vtotal", "integrated_high_risk", "unstable_zones")])
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("layer"))


@query(f"WITH {_STORED} SELECT k, s.layer, analysis, title, kind, suffix, rank::INTEGER AS rank FROM s JOIN (VALUES {_LAYERS}) t(analysis, layer, title, kind, suffix, rank) ON t.layer = s.layer")
def layer_catalogue(spark, sf_dir: str) -> DataFrame:
    return style.describe_layers(_stored(spark, sf_dir))


@query(f"WITH {_STORED} SELECT k, s.layer, r::INTEGER AS r, g::INTEGER AS g, b::INTEGER AS b, a::INTEGER AS a FROM s JOIN (VALUES {_FILLS}) t(layer, r, g, b, a) ON t.layer = s.layer")
def zone_styles(spark, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).withColumn("f", style.zone_fill(F.col("layer"))).filter("f IS NOT NULL").select("k", "layer", *[F.col("f")[x].alias(x) for x in "rgba"])


# Extents of some thousandths of a degree, and tiles of three sources scattered among them.
_REACH = """ext AS (SELECT p_partkey AS ext_id, 138.0 + p_partkey % 97 * 0.01 AS xmin, 35.0 + p_partkey * 7 % 89 * 0.01 AS ymin, 138.0 + p_partkey % 97 * 0.01 + p_size * 0.0002 AS xmax, 35.0 + p_partkey * 7 % 89 * 0.01 + p_size * 0.0001 AS ymax FROM part),
src AS (SELECT * FROM (VALUES ('DEM1A 1m', 17, 0), ('DEM5A 5m', 15, 1), ('DEM10B 10m', 14, 2)) t(source, zoom, priority)),
av AS (SELECT DISTINCT source, ((115780 + o_orderkey * 7 % 364) >> (17 - zoom))::BIGINT AS tx, ((51400 + o_custkey * 13 % 460) >> (17 - zoom))::BIGINT AS ty FROM orders JOIN src ON priority = o_orderkey % 23),
rg AS (SELECT ext_id, src.*, trunc((xmin + 180) / 360 * (1 << zoom))::BIGINT AS x0, trunc((xmax + 180) / 360 * (1 << zoom))::BIGINT AS x1,
  trunc((1 - ln(tan(radians(ymax)) + 1 / cos(radians(ymax))) / pi()) / 2 * (1 << zoom))::BIGINT AS y0, trunc((1 - ln(tan(radians(ymin)) + 1 / cos(radians(ymin))) / pi()) / 2 * (1 << zoom))::BIGINT AS y1 FROM ext, src)"""


def _reach(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = F.lit(138.0) + k % 97 * 0.01, F.lit(35.0) + k * 7 % 89 * 0.01
    extents_ = fx.table(spark, sf_dir, "part").select(k.alias("ext_id"), x.alias("xmin"), y.alias("ymin"), (x + size * 0.0002).alias("xmax"), (y + size * 0.0001).alias("ymax"))
    sources = tiles.registry(spark)
    o = F.col("o_orderkey")
    placed = fx.table(spark, sf_dir, "orders").withColumn("priority", (o % 23).cast("int")).join(F.broadcast(sources), "priority")  # three rows
    shift = lambda v: F.floor(v / F.pow(F.lit(2.0), 17 - F.col("zoom"))).cast("long")
    return extents_, placed.select("source", shift(115780 + o * 7 % 364).alias("tx"), shift(51400 + F.col("o_custkey") * 13 % 460).alias("ty")), sources


@query(f"WITH {_REACH}, m AS (SELECT ext_id, priority, source, zoom, x0, y0, x1, y1, count(*) AS found FROM rg JOIN av USING (source) WHERE tx BETWEEN x0 AND x1 AND ty BETWEEN y0 AND y1 GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ext_id ORDER BY priority) = 1) SELECT ext.ext_id, source, coalesce(zoom, -1) AS zoom, coalesce(x0, -1) AS x0, coalesce(y0, -1) AS y0, coalesce(x1, -1) AS x1, coalesce(y1, -1) AS y1, coalesce(found, 0) AS found FROM ext LEFT JOIN b ON b.ext_id = ext.ext_id")
def source_of_extents(spark, sf_dir: str) -> DataFrame:
    """The source that each extent falls back to; -1 and 0 where there is none."""
    return tiles.source_of_extents(*_reach(spark, sf_dir)).fillna(-1, ["zoom", "x0", "y0", "x1", "y1"]).fillna(0, ["found"])


@query(f"WITH {_REACH}, t AS (SELECT ext_id, tx, ty FROM rg, unnest(range(x0, x1 + 1)) p(tx), unnest(range(y0, y1 + 1)) q(ty) WHERE zoom = 17), m AS (SELECT ext_id, t.tx, t.ty, src.source, zoom, priority, av.tx AS sx, av.ty AS sy FROM t CROSS JOIN src JOIN av ON av.source = src.source AND av.tx = t.tx >> (17 - zoom) AND av.ty = t.ty >> (17 - zoom)) SELECT ext_id, tx, ty, source, zoom, sx, sy FROM m QUALIFY row_number() OVER (PARTITION BY ext_id, tx, ty ORDER BY priority) = 1")
def finest_cover(spark, sf_dir: str) -> DataFrame:
    """The finest tile there is for each tile of the finest zoom."""
    return tiles.finest_cover(*_reach(spark, sf_dir))


# The inverse series' coefficients for the ellipsoid (see rasters.utm_lonlat), spelled out for SQL.
_UTM_SQL = """m AS (SELECT 0.0016792203946287448::DOUBLE AS n),
k AS (SELECT n / 2 - 2 * n * n / 3 + 37 * n * n * n / 96 AS b1, n * n / 48 + n * n * n / 15 AS b2, 17 * n * n * n / 480 AS b3, 2 * n - 2 * n * n / 3 - 2 * n * n * n AS d1, 7 * n * n / 3 - 8 * n * n * n / 5 AS d2, 56 * n * n * n / 15 AS d3, 0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS a FROM m),
g AS (SELECT r, c, (3938965.0::DOUBLE - (r + 0.5) * 4) / a AS x, (381960.0::DOUBLE + (c + 0.5) * 4 - 500000) / a AS y, k.* FROM range(0, 60) p(r), range(0, 120) q(c), k),
s AS (SELECT *, x - b1 * sin(2 * x) * cosh(2 * y) - b2 * sin(4 * x) * cosh(4 * y) - b3 * sin(6 * x) * cosh(6 * y) AS u, y - b1 * cos(2 * x) * sinh(2 * y) - b2 * cos(4 * x) * sinh(4 * y) - b3 * cos(6 * x) * sinh(6 * y) AS v FROM g),
h AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM s),
l AS (SELECT r, c, 141 + degrees(atan2(sinh(v), cos(u))) AS lon, degrees(chi + d1 * sin(2 * chi) + d2 * sin(4 * chi) + d3 * sin(6 * chi)) AS lat FROM h),
f AS (SELECT r, c, (lon / 180 * 20037508.342789244::DOUBLE - 15551000) / 5 - 0.5 AS fc, (ln(tan(radians(45 + lat / 2))) / pi() * 20037508.342789244::DOUBLE - 4244000) / -5 - 0.5 AS fr FROM l)"""


@query(f"{_DEM}, {_UTM_SQL} SELECT f.r::INTEGER AS r, f.c::INTEGER AS c, CASE WHEN count(dem.z) = 4 THEN round(sum(dem.z * (1 - abs(fr - dem.r)) * (1 - abs(fc - dem.c))), 3) END AS z FROM f LEFT JOIN dem ON dem.r BETWEEN floor(fr) AND floor(fr) + 1 AND dem.c BETWEEN floor(fc) AND floor(fc) + 1 GROUP BY f.r, f.c")
def reproject_utm(spark, sf_dir: str) -> DataFrame:
    """The grid as if it were in Web Mercator, on a grid of UTM zone 54."""
    rows = fx.dem_meta(spark, sf_dir).rows
    source = GridMeta(rows, fx.COLS, 5.0, 15551000.0, 4244000.0, 5.0, -5.0, 3857)
    target = GridMeta(60, 120, 4.0, 381960.0, 3938965.0, 4.0, -4.0, 32654)
    out = rasters.reproject_to_utm(fx.dem(spark, sf_dir), source, 54, target)
    return out.select("r", "c", _r("z", 3).alias("z"))


# The target of the whole grid: the extent of its border by the forward series (see rasters.utm_target).
_HEAD, _TAIL = _UTM_SQL.split("\ng AS ")
_BORDER_SQL = """sz AS (SELECT max(r) + 1 AS nr FROM dem),
bp AS (SELECT i AS pr, j AS pc FROM sz, unnest(range(0, nr + 1)) p(i), (VALUES (0), (150)) q(j) UNION ALL SELECT i, j FROM sz, unnest([0, nr]) p(i), range(0, 151) q(j)),
bl AS (SELECT radians((15551000 + pc * 5) / 20037508.342789244::DOUBLE * 180 - 141) AS lam, sin(atan(sinh((4244000 - pr * 5) / 20037508.342789244::DOUBLE * pi()))) AS s, 2 * sqrt(n) / (1 + n) AS e, k.a, m.n FROM bp, k, m),
bt AS (SELECT *, sinh(0.5 * ln((1 + s) / (1 - s)) - e * 0.5 * ln((1 + e * s) / (1 - e * s))) AS t FROM bl),
bx AS (SELECT *, atan2(t, cos(lam)) AS xi, 0.5 * ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM bt),
be AS (SELECT 500000 + a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS e, a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS n FROM bx),
bb AS (SELECT floor(min(e) / 4) * 4 AS tx, ceil(max(n) / 4) * 4 AS ty, max(e) AS east, min(n) AS south FROM be),
tgt AS (SELECT tx, ty, ceil((ty - south) / 4)::BIGINT AS trows, ceil((east - tx) / 4)::BIGINT AS tcols FROM bb),"""
_WHOLE_UTM_SQL = f"{_HEAD}\n{_BORDER_SQL}\ng AS " + _TAIL.replace("3938965.0::DOUBLE", "ty").replace("381960.0::DOUBLE", "tx").replace("range(0, 60) p(r), range(0, 120) q(c)", "tgt, unnest(range(0, trows)) p(r), unnest(range(0, tcols)) q(c)")


@query(f"{_DEM}, {_WHOLE_UTM_SQL} SELECT f.r::INTEGER AS r, f.c::INTEGER AS c, CASE WHEN count(dem.z) = 4 THEN round(sum(dem.z * (1 - abs(fr - dem.r)) * (1 - abs(fc - dem.c))), 3) END AS z FROM f CROSS JOIN (VALUES (0), (1)) i(i) CROSS JOIN (VALUES (0), (1)) j(j) LEFT JOIN dem ON dem.r = floor(fr)::INTEGER + i AND dem.c = floor(fc)::INTEGER + j GROUP BY f.r, f.c")
def reproject_utm_whole(spark, sf_dir: str) -> DataFrame:
    """The whole grid as if it were in Web Mercator, on the grid of UTM zone 54 that covers it."""
    source = GridMeta(fx.dem_meta(spark, sf_dir).rows, fx.COLS, 5.0, 15551000.0, 4244000.0, 5.0, -5.0, 3857)
    out = rasters.reproject_to_utm(fx.dem(spark, sf_dir), source, 54, rasters.utm_target(spark, source, 54, 4.0))
    return out.select("r", "c", _r("z", 3).alias("z"))


# A second file in the survey's plane, whose cells lie among the first's; forward series as in rasters.transverse_mercator (origin 36, 138.5, scale 0.9999).
_PLANE_X0, _PLANE_Y0 = 108600.0, -45300.0
_PLANE_SQL = """w AS (SELECT l.r, l.c, (lon / 180 * 20037508.342789244::DOUBLE - 15551000) / 5 AS fc, (ln(tan(radians(45 + lat / 2))) / pi() * 20037508.342789244::DOUBLE - 4244000) / -5 AS fr,
  radians(lon - 138.5) AS lam, sin(radians(lat)) AS s, 2 * sqrt(k.n) / (1 + k.n) AS e, k.* EXCLUDE (b1, b2, b3, d1, d2, d3) FROM l, (SELECT k.*, m.n FROM k, m) k),
o AS (SELECT sin(radians(36.0::DOUBLE)) AS s, 2 * sqrt(n) / (1 + n) AS e, n, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM m),
o1 AS (SELECT *, atan(sinh(0.5 * ln((1 + s) / (1 - s)) - e * 0.5 * ln((1 + e * s) / (1 - e * s)))) AS y0 FROM o),
o2 AS (SELECT a1, a2, a3, y0 + a1 * sin(2 * y0) + a2 * sin(4 * y0) + a3 * sin(6 * y0) AS m0 FROM o1),
wt AS (SELECT *, sinh(0.5 * ln((1 + s) / (1 - s)) - e * 0.5 * ln((1 + e * s) / (1 - e * s))) AS t FROM w),
wx AS (SELECT *, atan2(t, cos(lam)) AS xi, 0.5 * ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) AS eta FROM wt),
pl AS (SELECT r, c, fr, fc, (0.9999 / 0.9996) * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS px,
  (0.9999 / 0.9996) * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) - m0) AS py FROM wx, o2)"""


@query(
    f"{_DEM}, {_WHOLE_UTM_SQL}, {_PLANE_SQL}, q AS (SELECT r, c, floor(fr)::BIGINT AS ar, floor(fc)::BIGINT AS ac, floor((py - {_PLANE_Y0}) / -3)::BIGINT AS br, floor((px - {_PLANE_X0}) / 3)::BIGINT AS bc FROM pl), "
    "b AS (SELECT r, c, z + 1000 AS z FROM dem WHERE c < 60) SELECT q.r::INTEGER AS r, q.c::INTEGER AS c, round(coalesce(b.z, a.z), 6) AS z FROM q LEFT JOIN dem a ON a.r = ar AND a.c = ac LEFT JOIN b ON b.r = br AND b.c = bc WHERE a.r IS NOT NULL OR b.r IS NOT NULL"
)
def mosaic_mixed_crs(spark, sf_dir: str) -> DataFrame:
    """A file in Web Mercator and one in the survey's plane as one grid of UTM zone 54; where they overlap the second wins."""
    dem = fx.dem(spark, sf_dir)
    first = GridMeta(fx.dem_meta(spark, sf_dir).rows, fx.COLS, 5.0, 15551000.0, 4244000.0, 5.0, -5.0, 3857)
    second = GridMeta(first.rows, 60, 3.0, _PLANE_X0, _PLANE_Y0, 3.0, -3.0, 6676)
    cells = dem.withColumn("path", F.lit("a")).unionByName(dem.filter("c < 60").withColumns({"path": F.lit("b"), "z": F.col("z") + 1000}))
    catalogue = warp.catalogue_of(spark, {"a": first, "b": second})
    out = rasters.mosaic(warp.warped(cells, catalogue, rasters.utm_target(spark, first, 54, 4.0)), order="path")
    return out.select("r", "c", _r("z").alias("z"))
