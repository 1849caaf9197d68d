"""Numbered runs: names, order, manifest and condition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = "dem_path string, analyses array<string>, duration_h double, rainfall_mmh double, total_mm double, runoff double, velocity_coef double, phi_deg double, c_kpa double, z_m double, m_sat double, fs_thresh double, twi_thresh double, min_area double"
#: The time in names of outputs that aren't to be replaced, for Python and for Spark (fixed values).
STAMP, SPARK_STAMP = "%Y%m%d_%H%M%S", "yyyyMMdd_HHmmss"
_NAME = r"^\d{4}(\+\d+)?$"


def run_name(seq: Column, files: Column) -> Column:
    """``0013`` for 3 files of run 001, ``0010+2`` for 12."""
    number = F.lpad(seq.cast("string"), 3, "0")
    return F.when(files <= 9, F.concat(number, files.cast("string"))).otherwise(F.concat(number, F.lit("0+"), (files - 10).cast("string")))


#: Layers that are written but don't count in a run's name (fixed values).
UNCOUNTED = ("slope", "shc")


def counted(layers: Column) -> Column:
    """How many of a run's layers its name counts."""
    return F.size(F.filter(layers, lambda k: ~k.isin(*UNCOUNTED)))


def stamped_name(name: Column, suffix: Column, at: Column) -> Column:
    """``name_20240131_235959.tif``: the name of an output that replaces none."""
    return F.concat(name, F.lit("_"), F.date_format(at, SPARK_STAMP), suffix)


def is_run(name: Column) -> Column:
    return name.rlike(_NAME)


def sorted_runs(names: DataFrame, column: str = "name") -> DataFrame:
    """Names of runs with their sequence number and files, in order."""
    runs = names.filter(is_run(F.col(column)))
    extra = F.nullif(F.regexp_extract(F.col(column), r"\+(\d+)$", 1), F.lit(""))
    files = F.when(extra.isNotNull(), extra.cast("int") + 10).otherwise(F.substring(column, 4, 1).cast("int"))
    return runs.withColumns({"seq": F.substring(column, 1, 3).cast("int"), "files": files}).orderBy("seq", "files")


def next_sequence(names: DataFrame, overwrite: bool = False, column: str = "name") -> DataFrame:
    """One row: the next sequence number, of three digits; after 999 comes 1000, which no run's name can have.

    Overwriting takes the last one again; nothing is deleted here.
    """
    last = sorted_runs(names, column).agg(F.max("seq").alias("last"))
    number = F.col("last") + (0 if overwrite else 1)
    return last.select(F.format_string("%03d", F.coalesce(number, F.lit(1))).alias("seq"))


def parse_manifest(text: Column) -> Column:
    return F.from_json(text, MANIFEST)


def condition_text(text: str) -> Column:
    """Lines on the conditions of a run from its manifest's JSON; a null is a run without one. The wording is fixed."""
    p = F.from_json(F.col(text), MANIFEST)
    field = lambda k: F.coalesce(p[k].cast("string"), F.lit("-"))
    ran = lambda k: F.array_contains(F.coalesce(p["analyses"], F.array().cast("array<string>")), k)
    flow = F.concat(F.lit("Flow: "), field("duration_h"), F.lit("h · "), field("rainfall_mmh"), F.lit("mm/h · total "), field("total_mm"), F.lit("mm"))
    stable = F.concat(F.lit("Stability: φ"), field("phi_deg"), F.lit("° · C="), field("c_kpa"), F.lit("kPa · z="), field("z_m"), F.lit("m · m="), field("m_sat"))
    valley = F.concat(F.lit("Valley: TWI≥"), field("twi_thresh"), F.lit(" · min area "), field("min_area"), F.lit(" m²"))
    lines = F.concat_ws("\n", F.when(ran("flow"), flow), F.when(ran("stability"), stable), F.when(ran("valley"), valley))
    broken = p.isNull() | (p["analyses"].isNull() & p["dem_path"].isNull() & ~F.trim(F.col(text)).rlike(r"^\{.*\}$"))
    return F.when(F.col(text).isNull(), "No condition data (legacy run)").when(broken, "Error reading condition file").when(lines == "", "No conditions").otherwise(lines)
