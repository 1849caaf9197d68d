"""Queries on elevation grids: stencils, drainage, stability, discharge, risk and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import style
from ridgeline.functions import terrain as t
from ridgeline.operators import drainage, outlines, rasters, stencil, zones
from ridgeline.plans import fixtures as fx
from ridgeline.plans.analysis import AnalysisParams, analyse, drained, terrain
from ridgeline.storage import materialise

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _r(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts)


_NEAR = _with(fx.DEM_SQL, fx.NEAR_SQL)
_DRAIN = _with(fx.DEM_SQL, fx.NEAR_SQL, fx.DRAIN_SQL)


@query(f"{_NEAR} SELECT r, c, round(slope, 6) AS slope FROM slopes")
def slope_deg(spark, sf_dir: str) -> DataFrame:
    out = stencil.slope(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir))
    return out.select("r", "c", _r("slope").alias("slope"))


@query(f"{_NEAR} SELECT r, c, round(-((xe - 2 * z + xw) / 25.0::DOUBLE + (xs - 2 * z + xn) / 25.0::DOUBLE), 6) AS curvature FROM edge")
def curvature(spark, sf_dir: str) -> DataFrame:
    out = stencil.curvature(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir))
    return out.select("r", "c", _r("curvature").alias("curvature"))


@query(
    f"""{_NEAR}, bent AS (SELECT r, c, z, -((xe - 2 * z + xw) / 25.0::DOUBLE + (xs - 2 * z + xn) / 25.0::DOUBLE) AS v FROM edge),
steps AS (SELECT a.k AS dr, b.k AS dc FROM range(-2, 3) a(k), range(-2, 3) b(k)),
around AS (SELECT q.r, q.c, greatest(0, least(mr, q.r + dr)) AS nr, greatest(0, least(149, q.c + dc)) AS nc FROM bent q, steps, lastr WHERE q.z IS NOT NULL),
dev AS (SELECT a.r, a.c, CASE WHEN count(b.v) <= 1 THEN 0.0 ELSE stddev_pop(b.v) END AS shc FROM around a JOIN bent b ON b.r = a.nr AND b.c = a.nc GROUP BY a.r, a.c)
SELECT bent.r, bent.c, round(dev.shc::FLOAT::DOUBLE, 4) AS shc FROM bent LEFT JOIN dev ON dev.r = bent.r AND dev.c = bent.c"""
)
def shc(spark, sf_dir: str) -> DataFrame:
    out = stencil.surface_complexity(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir))
    return out.select("r", "c", _r(F.col("shc").cast("double"), 4).alias("shc"))


@query(f"{_DRAIN} SELECT r, c, fdir::SMALLINT AS fdir FROM flow")
def d8_direction(spark, sf_dir: str) -> DataFrame:
    return stencil.flow_direction(fx.dem(spark, sf_dir)).select("r", "c", "fdir")


_BLUR = """WITH k AS (SELECT i, exp(-0.5 * (i / 2.0::DOUBLE) * (i / 2.0::DOUBLE)) AS w FROM range(-8, 9) t(i)), kn AS (SELECT i, w / (SELECT sum(w) FROM k) AS w FROM k),
{dem}, lastr AS (SELECT max(r) + 1 AS nr FROM dem), v AS (SELECT r, c, z, coalesce(z, 0.0) AS v FROM dem),
hi AS (SELECT v.r, v.c, (v.c + i + 300) % 300 AS m, w FROM v, kn), h AS (SELECT hi.r, hi.c, sum(w * v.v) AS h FROM hi JOIN v ON v.r = hi.r AND v.c = CASE WHEN m < 150 THEN m ELSE 299 - m END GROUP BY hi.r, hi.c),
vi AS (SELECT h.r, h.c, (h.r + i + 20 * nr) % (2 * nr) AS m, w, nr FROM h, kn, lastr), b AS (SELECT vi.r, vi.c, sum(w * h.h) AS b FROM vi JOIN h ON h.c = vi.c AND h.r = CASE WHEN m < nr THEN m ELSE 2 * nr - 1 - m END GROUP BY vi.r, vi.c)
SELECT v.r, v.c, CASE WHEN z IS NOT NULL THEN round(b, 5) END AS blurred FROM v JOIN b ON b.r = v.r AND b.c = v.c"""


@query(_BLUR.replace("{dem}", fx.DEM_SQL))
def gaussian_blur(spark, sf_dir: str) -> DataFrame:
    out = stencil.gaussian_blur(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir), "z", style.blur_sigma("weak"))
    return out.select("r", "c", _r("blurred", 5).alias("blurred"))


@query(f"{_DRAIN} SELECT r, c, accum FROM flow JOIN acc ON acc.id = flow.id")
def flow_accum(spark, sf_dir: str) -> DataFrame:
    return drained(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir)).select("r", "c", "accum")


_COEF = "t AS (SELECT dem.id, (greatest(3.0, least(10.0, coalesce(dsm.z - dem.z, 10.0))) - 3.0)::DOUBLE / 7.0 AS t FROM dem JOIN dsm ON dsm.id = dem.id), coef AS (SELECT id, (0.55 + t * (0.15 - 0.55)::DOUBLE)::FLOAT::DOUBLE AS c, (0.60 + t * (0.30 - 0.60)::DOUBLE)::FLOAT::DOUBLE AS v FROM t)"


def _canopied(spark, sf_dir: str) -> tuple[DataFrame, object]:
    meta = fx.dem_meta(spark, sf_dir)
    return rasters.canopy_height(fx.dem(spark, sf_dir), meta, fx.surface(spark, sf_dir), meta), meta


@query(f"{_with(fx.DEM_SQL, fx.SURFACE_SQL)} SELECT dem.r, dem.c, round(dsm.z - dem.z, 6) AS cs FROM dem JOIN dsm ON dsm.id = dem.id")
def canopy_height(spark, sf_dir: str) -> DataFrame:
    return _canopied(spark, sf_dir)[0].select("r", "c", _r("cs").alias("cs"))


@query(f"{_with(fx.DEM_SQL, fx.SURFACE_SQL, _COEF)} SELECT dem.r, dem.c, round(coef.c, 5) AS runoff, round(coef.v, 5) AS velocity FROM dem JOIN coef ON coef.id = dem.id")
def canopy_coefficients(spark, sf_dir: str) -> DataFrame:
    c, v = t.canopy_coefficients(F.col("cs"))
    return _canopied(spark, sf_dir)[0].select("r", "c", _r(c.cast("double"), 5).alias("runoff"), _r(v.cast("double"), 5).alias("velocity"))


@query(f"{_DRAIN}, {fx.SURFACE_SQL}, {_COEF}, wacc AS (SELECT node AS id, sum(coef.c) AS ww FROM up JOIN coef ON coef.id = up.src GROUP BY node) SELECT r, c, round(ww, 4) AS weighted, round(ww / greatest(accum, 1.0), 5) AS mean_upstream FROM flow JOIN acc ON acc.id = flow.id JOIN wacc ON wacc.id = flow.id".replace("SELECT r, c, round(ww", "SELECT flow.r, flow.c, round(ww"))
def flow_accum_weighted(spark, sf_dir: str) -> DataFrame:
    cells, meta = _canopied(spark, sf_dir)
    cells = cells.withColumn("c_coef", t.canopy_coefficients(F.col("cs"))[0].cast("double"))
    out = drained(cells, meta, ["c_coef"])
    return out.select("r", "c", _r("accum_c_coef", 4).alias("weighted"), _r(F.col("accum_c_coef") / F.greatest("accum", F.lit(1.0)), 5).alias("mean_upstream"))


@query(f"{_DRAIN} SELECT r, c, round({fx.TWI_SQL}, 6) AS twi FROM flow JOIN acc ON acc.id = flow.id")
def twi(spark, sf_dir: str) -> DataFrame:
    meta = fx.dem_meta(spark, sf_dir)
    out = drained(fx.dem(spark, sf_dir), meta)
    return out.select("r", "c", _r(t.wetness_index(F.col("accum"), F.col("slope"), meta.cell)).alias("twi"))


@query(f"{_DRAIN} SELECT r, c, round({fx.TWI_SQL}, 6) AS twi, accum FROM flow JOIN acc ON acc.id = flow.id WHERE {fx.TWI_SQL} >= 8.0 AND accum >= 1000 / 25.0")
def valley_cells(spark, sf_dir: str) -> DataFrame:
    meta = fx.dem_meta(spark, sf_dir)
    out = drained(fx.dem(spark, sf_dir), meta).withColumn("twi", t.wetness_index(F.col("accum"), F.col("slope"), meta.cell))
    return out.filter((F.col("twi") >= 8.0) & (F.col("accum") >= 1000 / meta.cell**2)).select("r", "c", _r("twi").alias("twi"), "accum")


def _safety(spark, sf_dir: str) -> DataFrame:
    cells = stencil.slope(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir))
    return cells.withColumn("fs", t.safety_factor(F.col("slope")))


@query(f"{_NEAR} SELECT r, c, round({fx.FS_SQL}, 6) AS fs FROM slopes")
def stability_fs(spark, sf_dir: str) -> DataFrame:
    return _safety(spark, sf_dir).select("r", "c", _r("fs").alias("fs"))


@query(f"{_NEAR}, f AS (SELECT {fx.FS_SQL} AS fs FROM slopes) SELECT CASE WHEN fs < 1.0 THEN 'unstable' WHEN fs < 1.5 THEN 'caution' ELSE 'stable' END AS class, count(*) AS n_cells, count(*) * 25.0::DOUBLE AS area_m2 FROM f WHERE fs IS NOT NULL GROUP BY 1")
def stability_class_area(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("fs") < 1.0, "unstable").when(F.col("fs") < 1.5, "caution").otherwise("stable")
    known = _safety(spark, sf_dir).filter("fs IS NOT NULL")
    return known.groupBy(kind.alias("class")).agg(F.count("*").alias("n_cells"), (F.count("*") * 25.0).alias("area_m2"))


@query(f"{_NEAR} SELECT r, c, round({fx.FS_SQL}, 6) AS fs FROM slopes WHERE {fx.FS_SQL} < 1.5")
def unstable_cells(spark, sf_dir: str) -> DataFrame:
    return _safety(spark, sf_dir).filter("fs < 1.5").select("r", "c", _r("fs").alias("fs"))


@query(f"{_DRAIN}, {fx.HOURS_SQL} SELECT r, c, round(hours, 8) AS hours FROM hours")
def travel_time(spark, sf_dir: str) -> DataFrame:
    meta = fx.dem_meta(spark, sf_dir)
    hours = t.travel_hours(F.col("dzdx"), F.col("dzdy"), F.col("fdir"), meta.cell)
    return terrain(fx.dem(spark, sf_dir), meta).select("r", "c", _r(hours, 8).alias("hours"))


def _timed(spark, sf_dir: str, holes: bool) -> tuple[DataFrame, object]:
    meta = fx.dem_meta(spark, sf_dir)
    cells = terrain(fx.dem(spark, sf_dir, holes), meta)
    cells = cells.withColumn("hours", t.travel_hours(F.col("dzdx"), F.col("dzdy"), F.col("fdir"), meta.cell))
    return drainage.drain(materialise(cells, "timed"), meta, hours="hours"), meta


_TC = _with("{dem}", fx.NEAR_SQL, fx.DRAIN_SQL, fx.TC_SQL)
_TC_WHOLE, _TC_HOLES = _TC.replace("{dem}", fx.WHOLE_SQL), _TC.replace("{dem}", fx.DEM_SQL)


@query(f"{_TC_WHOLE} SELECT r, c, round(tc, 6) AS tc FROM flow JOIN tcs ON tcs.id = flow.id")
def tc(spark, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir, False)[0].select("r", "c", _r("tc").alias("tc"))


@query(f"{_TC_HOLES} SELECT r, c, round(tc, 6) AS tc FROM flow JOIN tcs ON tcs.id = flow.id")
def tc_nodata(spark, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir, True)[0].select("r", "c", _r("tc").alias("tc"))


@query(f"{_DRAIN} SELECT r, c, round(0.8 * 50.0 * (accum * 25.0 / 10000.0) / 360.0, 6) AS q FROM flow JOIN acc ON acc.id = flow.id")
def rational_flow(spark, sf_dir: str) -> DataFrame:
    meta = fx.dem_meta(spark, sf_dir)
    return drained(fx.dem(spark, sf_dir), meta).select("r", "c", _r(t.rational_flow(F.col("accum"), meta.cell)).alias("q"))


_METRICS = "round(0.8 * 50.0 * (a * 25.0 / 10000.0)::DOUBLE / 360.0, 6) AS q_peak, round(0.8 * (100.0::DOUBLE / 6.0) * (a * 25.0 / 10000.0) / 360.0, 6) AS q_mean, round(0.8 * (100.0::DOUBLE / 6.0) * (a * 25.0 / 10000.0) / 360.0 * 6.0 * 3600.0, 4) AS volume"


def _metrics(q: tuple[Column, Column, Column]) -> list[Column]:
    return [_r(q[0]).alias("q_peak"), _r(q[1]).alias("q_mean"), _r(q[2], 4).alias("volume")]


@query(f"{_DRAIN}, q AS (SELECT r, c, accum AS a FROM flow JOIN acc ON acc.id = flow.id) SELECT r, c, {_METRICS} FROM q")
def rational_3(spark, sf_dir: str) -> DataFrame:
    meta = fx.dem_meta(spark, sf_dir)
    return drained(fx.dem(spark, sf_dir), meta).select("r", "c", *_metrics(t.rational_metrics(F.col("accum"), meta.cell)))


_SHARE = "q AS (SELECT flow.*, accum, accum * least(1.0, 0.05::DOUBLE / greatest(coalesce(tc, 1e-6), 1e-6)) AS a FROM flow JOIN acc ON acc.id = flow.id JOIN tcs ON tcs.id = flow.id)"
_SHORT = "round(0.8 * 50.0 * (a * 25.0 / 10000.0)::DOUBLE / 360.0, 6) AS q_peak, round(0.8 * (100.0::DOUBLE / 0.1) * (a * 25.0 / 10000.0) / 360.0, 6) AS q_mean, round(0.8 * (100.0::DOUBLE / 0.1) * (a * 25.0 / 10000.0) / 360.0 * 0.05 * 3600.0, 4) AS volume"


@query(f"{_TC_WHOLE}, {_SHARE} SELECT r, c, {_SHORT} FROM q")
def routed_flow(spark, sf_dir: str) -> DataFrame:
    cells, meta = _timed(spark, sf_dir, False)
    return cells.select("r", "c", *_metrics(t.routed_metrics(F.col("accum"), F.col("tc"), meta.cell, hours=0.05)))


@query(f"{_TC_HOLES}, q AS (SELECT flow.r, flow.c, accum * least(1.0, 6.0::DOUBLE / greatest(coalesce(tc, 1e-6), 1e-6)) AS a FROM flow JOIN acc ON acc.id = flow.id JOIN tcs ON tcs.id = flow.id) SELECT r, c, {_METRICS} FROM q")
def routed_flow_nodata(spark, sf_dir: str) -> DataFrame:
    cells, meta = _timed(spark, sf_dir, True)
    return cells.select("r", "c", *_metrics(t.routed_metrics(F.col("accum"), F.col("tc"), meta.cell)))


# The flow layer is scaled so that both of its thresholds are met on the fixture.
_LAYERS = f"lay AS (SELECT flow.r, flow.c, flow.id, z, ({fx.FS_SQL})::FLOAT::DOUBLE AS fs, ({fx.TWI_SQL})::FLOAT::DOUBLE AS twi, (40.0 * 0.8 * 50.0 * (accum * 25.0 / 10000.0)::DOUBLE / 360.0)::FLOAT::DOUBLE AS flow FROM flow JOIN acc ON acc.id = flow.id)"
_ADD = "(CASE WHEN fs < 1.0 THEN 3.0 WHEN fs < 1.5 THEN 2.0 ELSE 0.0 END + CASE WHEN twi >= 8.0 THEN 1.0 ELSE 0.0 END + CASE WHEN flow >= 1.0 THEN 2.0 WHEN flow >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE"
_RISKS = f"{_DRAIN}, {_LAYERS}, risk AS (SELECT r, c, id, {_ADD} AS risk FROM lay WHERE coalesce(fs, twi, flow) IS NOT NULL)"


def _layers(spark, sf_dir: str) -> DataFrame:
    meta = fx.dem_meta(spark, sf_dir)
    cells = drained(fx.dem(spark, sf_dir), meta)
    flow = 40.0 * t.rational_flow(F.col("accum"), meta.cell)
    values = {"fs": t.safety_factor(F.col("slope")), "twi": t.wetness_index(F.col("accum"), F.col("slope"), meta.cell), "flow": flow}
    return cells.select("r", "c", *[t.as_stored(v).alias(k) for k, v in values.items()])


def _risks(spark, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("r", "c", t.additive_risk(F.col("fs"), F.col("twi"), F.col("flow")).alias("risk"))


@query(f"{_RISKS} SELECT r, c, risk FROM risk")
def risk_additive(spark, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir)


@query(f"{_DRAIN}, {_LAYERS} SELECT r, c, (CASE WHEN fs < 1.0 THEN 4.0 WHEN fs < 1.5 THEN 2.0 ELSE 1.0 END * CASE WHEN twi >= 8.0 THEN 2.0 ELSE 1.0 END * CASE WHEN flow >= 1.0 THEN 4.0 WHEN flow >= 0.5 THEN 2.0 ELSE 1.0 END)::DOUBLE AS risk FROM lay")
def risk_multiplicative(spark, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("r", "c", t.multiplicative_risk(F.col("fs"), F.col("twi"), F.col("flow")).alias("risk"))


@query(f"{_RISKS} SELECT risk, count(*) AS n_cells, count(*) * 25.0::DOUBLE AS area_m2 FROM risk GROUP BY risk")
def risk_class_area(spark, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir).groupBy("risk").agg(F.count("*").alias("n_cells"), (F.count("*") * 25.0).alias("area_m2"))


_ZONES = """pairs AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON (b.id = a.id + 1 AND a.c < 149) OR b.id = a.id + 150),
twoway AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id, id AS node FROM mask UNION SELECT reach.id, twoway.b FROM reach JOIN twoway ON twoway.a = reach.node),
zoned AS (SELECT id, min(node) AS zone FROM reach GROUP BY id)
SELECT zone, 1 AS value, count(*) AS n_cells, count(*) * 25.0::DOUBLE AS area, min(c) * 5.0::DOUBLE AS xmin, max(c) * 5.0::DOUBLE + 5.0 AS xmax, (mr - max(r)) * 5.0::DOUBLE AS ymin, (mr - min(r)) * 5.0::DOUBLE + 5.0 AS ymax, round(avg(c * 5.0 + 2.5), 4) AS cx, round(avg((mr - r) * 5.0 + 2.5), 4) AS cy
FROM zoned JOIN mask ON mask.id = zoned.id, lastr GROUP BY zone, mr"""


def _zone_rows(mask: DataFrame, meta) -> DataFrame:
    stats = zones.zone_statistics(zones.label_zones(materialise(mask.select("r", "c"), "mask"), meta), meta)
    return stats.select("zone", "value", "n_cells", "area", "xmin", "xmax", "ymin", "ymax", _r("cx", 4).alias("cx"), _r("cy", 4).alias("cy"))


@query(f"{_RISKS}, mask AS (SELECT r, c, id FROM risk WHERE risk >= 4), {_ZONES}")
def high_risk_zones(spark, sf_dir: str) -> DataFrame:
    return _zone_rows(_risks(spark, sf_dir).filter("risk >= 4"), fx.dem_meta(spark, sf_dir))


@query(f"{_DRAIN}, mask AS (SELECT r, c, flow.id FROM flow JOIN acc ON acc.id = flow.id WHERE {fx.TWI_SQL} >= 8.0 AND accum >= 40), {_ZONES}")
def valley_zones(spark, sf_dir: str) -> DataFrame:
    return _zone_rows(valley_cells(spark, sf_dir), fx.dem_meta(spark, sf_dir))


_ZONED = _ZONES[: _ZONES.rindex("SELECT zone, 1")].rstrip()
_VALLEYS = f"{_DRAIN}, mask AS (SELECT r, c, flow.id FROM flow JOIN acc ON acc.id = flow.id WHERE {fx.TWI_SQL} >= 8.0 AND accum >= 40), {_ZONED}"


@query(
    f"""{_VALLEYS},
cell AS (SELECT mask.id, r, c, zone FROM zoned JOIN mask ON mask.id = zoned.id),
way AS (SELECT * FROM (VALUES (0, -1, 0, 0, 1, 0, 1), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 0, -1, 1, 0), (3, 0, -1, -1, 0, 0, 0)) t(d, dr, dc, hr, hc, vr, vc)),
side AS (SELECT a.id * 4 + d AS s, a.zone, d, a.r + vr AS er, a.c + vc AS ec, hr, hc,
    CASE WHEN ah.id IS NULL THEN a.id * 4 + (d + 1) % 4 WHEN ac.id IS NULL THEN ah.id * 4 + d ELSE ac.id * 4 + (d + 3) % 4 END AS nxt
  FROM cell a CROSS JOIN way LEFT JOIN cell n ON n.r = a.r + dr AND n.c = a.c + dc AND n.zone = a.zone
  LEFT JOIN cell ah ON ah.r = a.r + hr AND ah.c = a.c + hc AND ah.zone = a.zone LEFT JOIN cell ac ON ac.r = a.r + hr + dr AND ac.c = a.c + hc + dc AND ac.zone = a.zone WHERE n.id IS NULL),
walk AS (SELECT s, nxt AS onto FROM side UNION SELECT walk.s, side.nxt FROM walk JOIN side ON side.s = walk.onto),
ring AS (SELECT s, min(onto) AS ring FROM walk GROUP BY s)
SELECT zone, ring, count(*) FILTER (WHERE nxt % 4 <> d) AS corners, count(*) * 5.0::DOUBLE AS perimeter, sum((ec - hc) * er - ec * (er - hr)) * 12.5::DOUBLE AS area FROM side JOIN ring ON ring.s = side.s GROUP BY zone, ring"""
)
def zone_rings(spark, sf_dir: str) -> DataFrame:
    """Rings of the valleys' zones; tiles of 32 cells, so that rings cross their borders."""
    meta = fx.dem_meta(spark, sf_dir)
    labelled = zones.label_zones(materialise(valley_cells(spark, sf_dir).select("r", "c"), "mask"), meta)
    return outlines.zone_rings(outlines.ring_parts(labelled, meta, tile=32), meta)


@query(
    f"{_TC_HOLES}, q AS (SELECT flow.*, accum, 0.8 * 50.0 * (accum * least(1.0, 6.0::DOUBLE / greatest(coalesce(tc, 1e-6), 1e-6)) * 25.0 / 10000.0)::DOUBLE / 360.0 AS peak FROM flow JOIN acc ON acc.id = flow.id JOIN tcs ON tcs.id = flow.id), "
    f"lay AS (SELECT *, ({fx.FS_SQL})::FLOAT::DOUBLE AS fs, ({fx.TWI_SQL})::FLOAT::DOUBLE AS twi, peak::FLOAT::DOUBLE AS flow FROM q) "
    f"SELECT {_ADD} AS risk, count(*) AS n_cells, count(CASE WHEN fs < 1.5 THEN 1 END) AS n_unstable, count(CASE WHEN twi >= 8.0 AND accum >= 40 THEN 1 END) AS n_valley, round(sum(peak), 3) AS peak FROM lay GROUP BY 1"
)
def full_analysis(spark, sf_dir: str) -> DataFrame:
    """All analyses at their defaults, summed by risk class."""
    cells = analyse(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir), AnalysisParams(flow=True))
    count = lambda c: F.sum(F.col(c).cast("long"))
    return cells.groupBy(F.col("integrated_risk_index").alias("risk")).agg(F.count("*").alias("n_cells"), count("unstable").alias("n_unstable"), count("valley").alias("n_valley"), _r(F.sum("flow_peak"), 3).alias("peak"))


@query(f"{_with(fx.DEM_SQL)}, m AS (SELECT max(r) + 1 AS n FROM dem) SELECT c * 5.0::DOUBLE + 2.5 AS x, (n - r) * 5.0::DOUBLE - 2.5 AS y, round(z, 6) AS value FROM dem, m WHERE z > 150.0")
def threshold_points(spark, sf_dir: str) -> DataFrame:
    out = rasters.points_above(fx.dem(spark, sf_dir), fx.dem_meta(spark, sf_dir), 150.0)
    return out.select("x", "y", _r("value").alias("value"))


_CHANNEL = "floor(CASE WHEN fs <= 0 THEN {0} WHEN fs <= 1 THEN {0} + (fs - 0) * ({1} - {0}) WHEN fs <= 2 THEN {1} + (fs - 1) * ({2} - {1}) WHEN fs <= 3 THEN {2} + (fs - 2) * ({3} - {2}) WHEN fs <= 4 THEN {3} + (fs - 3) * ({4} - {3}) ELSE {4} END + 1e-6)::INTEGER"


@query(f"{_NEAR}, f AS (SELECT r AS row_no, c AS col_no, {fx.FS_SQL} AS fs FROM slopes) SELECT row_no, col_no, {_CHANNEL.format(215, 245, 206, 166, 26)} AS red, {_CHANNEL.format(25, 251, 234, 217, 150)} AS green, {_CHANNEL.format(28, 182, 144, 106, 65)} AS blue, 255 AS alpha FROM f WHERE fs IS NOT NULL")
def colour_ramp(spark, sf_dir: str) -> DataFrame:
    shade = style.ramp(F.col("fs"), style.FIXED["stability_fs"])
    out = _safety(spark, sf_dir).filter("fs IS NOT NULL").select(F.col("r").alias("row_no"), F.col("c").alias("col_no"), shade.alias("s"))
    return out.select("row_no", "col_no", F.col("s.r").alias("red"), F.col("s.g").alias("green"), F.col("s.b").alias("blue"), F.col("s.a").alias("alpha"))


@query(
    """WITH v AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
s AS (SELECT k, v, lo, hi, pow(10.0, log10(lo) + (log10(hi) - log10(lo)) * 0.5) AS mid FROM v, m)
SELECT k, CASE WHEN v <= lo THEN 0 WHEN v <= mid THEN floor((v - lo) / (mid - lo) * 89 + 1e-6)::INTEGER WHEN v <= hi THEN floor(89 + (v - mid) / (hi - mid) * 166 + 1e-6)::INTEGER ELSE 255 END AS alpha,
CASE WHEN v <= lo THEN 255 WHEN v <= mid THEN floor(255 + (v - lo) / (mid - lo) * (220 - 255) + 1e-6)::INTEGER WHEN v <= hi THEN floor(220 + (v - mid) / (hi - mid) * (150 - 220) + 1e-6)::INTEGER ELSE 150 END AS red FROM s"""
)
def colour_ramp_dynamic(spark, sf_dir: str) -> DataFrame:
    values = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    limits = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    shade = style.ramp(F.col("v"), style.dynamic_stops("flow_peak", F.col("lo"), F.col("hi"), "low"))
    return values.join(F.broadcast(limits)).select("k", shade.alias("s")).select("k", F.col("s.a").alias("alpha"), F.col("s.r").alias("red"))
