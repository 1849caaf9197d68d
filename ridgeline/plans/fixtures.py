"""Grids, clouds and catalogues derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta, from_keys

COLS = 150
FOLDER_SQL = "substr('LMNOP', (k % 5 + 1)::INTEGER, 1) || substr('BCDEF', (k // 5 % 5 + 1)::INTEGER, 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem_meta(spark: SparkSession, sf_dir: str) -> GridMeta:
    rows = -(-table(spark, sf_dir, "orders").count() // COLS)
    return GridMeta(rows, COLS, 5.0, 0.0, rows * 5.0, 5.0, -5.0, 32654)


def dem(spark: SparkSession, sf_dir: str, holes: bool = True) -> DataFrame:
    """A tilted surface with a cell for each order; with holes, every 97th has no data."""
    k = F.col("o_orderkey")
    side = F.lit(150) - k % COLS
    z = F.lit(0.01) * side * side + F.col("o_totalprice") / 250000.0
    return from_keys(table(spark, sf_dir, "orders"), "o_orderkey", COLS, F.when(k % 97 != 13, z) if holes else z)


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground with a canopy of 0 to 12 m on it; every 101st cell has no data."""
    k = F.col("o_orderkey")
    side = F.lit(150) - k % COLS
    z = F.lit(0.01) * side * side + F.col("o_totalprice") / 250000.0 + F.col("o_custkey") % 13
    return from_keys(table(spark, sf_dir, "orders"), "o_orderkey", COLS, F.when((k % 97 != 13) & (k % 101 != 7), z))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_partkey") % 100).cast("double") + F.col("l_discount")
    y = F.col("l_suppkey").cast("double") + F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), F.col("l_quantity").cast("float").alias("z"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    folder = F.concat(F.substring(F.lit("LMNOP"), (k % 5 + 1).cast("int"), F.lit(1)), F.substring(F.lit("BCDEF"), (F.floor(k / 5) % 5 + 1).cast("int"), F.lit(1)))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.format_string("08%s%02d%02d", folder, (k % 100).cast("int"), (k * 7 % 100).cast("int")).alias("code"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and types in which a code was surveyed; every eleventh code never was."""
    k = F.col("k")
    years, types = F.array(*map(F.lit, (2019, 2020, 2021, 2022, 2025))), F.array(*map(F.lit, ("Grid", "Original", "Ground", "Ortho")))
    base = codes(spark, sf_dir).filter(k % 11 != 5).withColumn("j", F.explode(F.array(*map(F.lit, range(4)))))
    return base.select(F.get(years, ((k * 3 + F.col("j") * 2) % 5).cast("int")).alias("year"), F.get(types, ((k + F.col("j") * (k % 3)) % 4).cast("int")).alias("lp_type"), "code")


def _dem_sql(name: str, z: str) -> str:
    return f"{name} AS (SELECT (o_orderkey // 150)::INTEGER AS r, (o_orderkey % 150)::INTEGER AS c, o_orderkey AS id, {z} AS z FROM orders)"


_Z = "(0.01::DOUBLE * (150 - o_orderkey % 150) * (150 - o_orderkey % 150) + o_totalprice / 250000.0::DOUBLE)"
DEM_SQL = _dem_sql("dem", f"CASE WHEN o_orderkey % 97 <> 13 THEN {_Z} END")
WHOLE_SQL = _dem_sql("dem", _Z)
SURFACE_SQL = _dem_sql("dsm", f"CASE WHEN o_orderkey % 97 <> 13 AND o_orderkey % 101 <> 7 THEN {_Z} + o_custkey % 13 END")
CODES_SQL = f"codes AS (SELECT k, '08' || {FOLDER_SQL} || lpad((k % 100)::VARCHAR, 2, '0') || lpad((k * 7 % 100)::VARCHAR, 2, '0') AS code FROM (SELECT p_partkey AS k FROM part))"
CATALOG_SQL = CODES_SQL + ", catalog AS (SELECT ([2019, 2020, 2021, 2022, 2025])[((k * 3 + j * 2) % 5 + 1)::INTEGER] AS year, (['Grid', 'Original', 'Ground', 'Ortho'])[((k + j * (k % 3)) % 4 + 1)::INTEGER] AS lp_type, code FROM codes, range(4) t(j) WHERE k % 11 <> 5)"

#: Cells with their eight neighbours: null where there is none or it has no data.
NEAR_SQL = """lastr AS (SELECT max(r) AS mr FROM dem),
nb AS (SELECT d.*, nw.z AS nw, n.z AS n, ne.z AS ne, w.z AS w, e.z AS e, sw.z AS sw, s.z AS s, se.z AS se
  FROM dem d LEFT JOIN dem nw ON nw.r = d.r - 1 AND nw.c = d.c - 1 LEFT JOIN dem n ON n.r = d.r - 1 AND n.c = d.c LEFT JOIN dem ne ON ne.r = d.r - 1 AND ne.c = d.c + 1
  LEFT JOIN dem w ON w.r = d.r AND w.c = d.c - 1 LEFT JOIN dem e ON e.r = d.r AND e.c = d.c + 1
  LEFT JOIN dem sw ON sw.r = d.r + 1 AND sw.c = d.c - 1 LEFT JOIN dem s ON s.r = d.r + 1 AND s.c = d.c LEFT JOIN dem se ON se.r = d.r + 1 AND se.c = d.c + 1),
edge AS (SELECT *, CASE WHEN c = 0 THEN z ELSE w END AS xw, CASE WHEN c = 149 THEN z ELSE e END AS xe, CASE WHEN r = 0 THEN z ELSE n END AS xn, CASE WHEN r = mr THEN z ELSE s END AS xs FROM nb, lastr),
grad AS (SELECT *, CASE WHEN z IS NOT NULL THEN (xe - xw) / 10.0::DOUBLE END AS gx, CASE WHEN z IS NOT NULL THEN (xs - xn) / 10.0::DOUBLE END AS gy FROM edge),
slopes AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM grad)"""

DRAIN_SQL = """drops AS (SELECT *, greatest((z - nw) / 1.4142::DOUBLE, z - n, (z - ne) / 1.4142::DOUBLE, z - w, z - e, (z - sw) / 1.4142::DOUBLE, z - s, (z - se) / 1.4142::DOUBLE) AS most FROM slopes),
dirs AS (SELECT *, CASE WHEN most IS NULL OR most <= 0 THEN 0 WHEN (z - nw) / 1.4142::DOUBLE = most THEN 32 WHEN z - n = most THEN 64 WHEN (z - ne) / 1.4142::DOUBLE = most THEN 128
  WHEN z - w = most THEN 16 WHEN z - e = most THEN 1 WHEN (z - sw) / 1.4142::DOUBLE = most THEN 8 WHEN z - s = most THEN 4 WHEN (z - se) / 1.4142::DOUBLE = most THEN 2 ELSE 0 END AS fdir FROM drops),
flow AS (SELECT *, CASE fdir WHEN 32 THEN id - 151 WHEN 64 THEN id - 150 WHEN 128 THEN id - 149 WHEN 16 THEN id - 1 WHEN 1 THEN id + 1 WHEN 8 THEN id + 149 WHEN 4 THEN id + 150 WHEN 2 THEN id + 151 END AS p FROM dirs),
up AS (SELECT id AS src, id AS node FROM flow UNION ALL SELECT up.src, flow.p FROM up JOIN flow ON flow.id = up.node WHERE flow.p IS NOT NULL),
acc AS (SELECT node AS id, count(*)::DOUBLE AS accum FROM up GROUP BY node)"""

HOURS_SQL = "hours AS (SELECT *, CASE WHEN fdir IN (2, 8, 32, 128) THEN 5.0::DOUBLE * 1.4142::DOUBLE ELSE 5.0::DOUBLE END / (0.3::DOUBLE * pow(CASE WHEN gx * gx + gy * gy IS NULL THEN NULL ELSE greatest(sqrt(gx * gx + gy * gy), 0.001::DOUBLE) END, 0.5::DOUBLE)) / 3600.0::DOUBLE AS hours FROM flow)"
TC_SQL = HOURS_SQL + """,
cums AS (SELECT up.src AS id, CASE WHEN count(*) = count(h.hours) THEN sum(h.hours) END AS cum FROM up JOIN hours h ON h.id = up.node GROUP BY up.src),
tcs AS (SELECT up.node AS id, max(far.cum) - any_value(own.cum) AS tc FROM up JOIN cums far ON far.id = up.src JOIN cums own ON own.id = up.node GROUP BY up.node)"""
FS_SQL = "CASE WHEN slope IS NULL THEN NULL WHEN 18.0 * sin(radians(slope)) * cos(radians(slope)) > 1e-6 THEN (18.0::DOUBLE - 0.5 * 9.81) * cos(radians(slope)) * cos(radians(slope)) * tan(radians(35.0::DOUBLE)) / (18.0 * sin(radians(slope)) * cos(radians(slope))) ELSE 'Infinity'::DOUBLE END"
TWI_SQL = "CASE WHEN slope IS NULL THEN NULL ELSE ln(accum * 25.0::DOUBLE / tan(radians(greatest(slope, 0.1::DOUBLE)))) END"
