"""Runs on disk: layers of cells, a manifest, zones, and what integrates stored layers.

A run's number is claimed by a file that only one writer can create. Its data go to a folder
of their own inside the run's, and the manifest, a file written last, names that folder: a
run is there when its manifest is, and an overwritten one changes with its manifest. Nothing
is renamed, so stores without renames will do. What fails is removed; what a lost driver
left behind, ``recover`` removes.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import time
import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import terrain as t
from ridgeline.grid import GridMeta
from ridgeline.operators import outlines, runs, zones
from ridgeline.plans.analysis import AnalysisParams
from ridgeline.sources.cells import read_cells, write_cells

LAYERS = ("slope", "shc", "stability_fs", "twi", "tc", "flow_peak", "flow_mean", "flow_vtotal", "integrated_risk_index")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


MANIFEST, CLAIM = "params.json", ".claim_"


def run_names(spark: SparkSession, out_dir: str) -> list[str]:
    """Folders that have a manifest."""
    files, pattern = _fs(spark, f"{out_dir}/*/{MANIFEST}")
    return sorted(s.getPath().getParent().getName() for s in files.globStatus(pattern) or ())


def _claimed(spark: SparkSession, path: str) -> bool:
    """Creates a file that no one else has; false if it is there."""
    files, place = _fs(spark, path)
    files.mkdirs(place.getParent())
    if files.getScheme() == "file":  # Hadoop's own local files are checked before they are made
        try:
            os.close(os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        files.create(place, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _claim(spark: SparkSession, out_dir: str, overwrite: bool) -> str:
    """A number that is this writer's until its claim is deleted: the next that is free, or the last to overwrite it."""
    names = spark.createDataFrame([(n,) for n in run_names(spark, out_dir)], "name string")
    seq = runs.next_sequence(names, overwrite).first().seq
    while True:
        if len(seq) > 3:
            raise ValueError("all run numbers are taken")
        if _claimed(spark, f"{out_dir}/{CLAIM}{seq}"):
            # Another writer may have finished since the names were listed.
            if overwrite or not any(n[:3] == seq for n in run_names(spark, out_dir)):
                return seq
            _delete(spark, f"{out_dir}/{CLAIM}{seq}")
        elif overwrite:
            raise FileExistsError(f"run {seq} is being written")
        seq = f"{int(seq) + 1:03d}"


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _fs(spark, path)
    files.delete(place, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, which takes the place of what is there when it is closed."""
    files, place = _fs(spark, path)
    if files.getScheme() == "file":
        local = place.toUri().getPath()
        with open(f"{local}.new", "w") as f:
            f.write(text)
        os.replace(f"{local}.new", local)
        return
    out = files.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_run(cells: DataFrame, meta: GridMeta, params: AnalysisParams, out_dir: str, dem_path: str = "", overwrite: bool = False) -> str:
    """Writes a run's layers as 32-bit values in tiles, its zones and its manifest; returns its name.

    Overwriting takes the last number again: its runs go once the new one is whole.
    """
    spark = cells.sparkSession
    layers = [k for k in LAYERS if k in cells.columns]
    kinds = {"unstable": "unstable_zones", "valley": "valley_zones", "high_risk": "integrated_high_risk"}
    masks = [k for k in kinds if k in cells.columns]
    n = runs.counted(F.array(*[F.lit(k) for k in (*layers, *masks)]))
    seq = _claim(spark, out_dir, overwrite)
    data = f"data-{uuid.uuid4().hex}"
    name = None
    try:
        name = spark.range(1).select(runs.run_name(F.lit(seq), n).alias("name")).first().name
        old = [x for x in run_names(spark, out_dir) if x[:3] == seq]
        if name in run_names(spark, out_dir) and name not in old:
            raise FileExistsError(f"{out_dir}/{name} is there already")
        place = f"{out_dir}/{name}/{data}"
        write_cells(cells.select("r", "c", *[F.col(k).cast("float").alias(k) for k in layers], *masks), meta, f"{place}/cells")
        stored = read_cells(spark, f"{place}/cells")
        for k in masks:
            labelled = zones.label_zones(stored.filter(k).select("r", "c"), meta)
            outlines.zone_outlines(labelled, meta).join(zones.zone_statistics(labelled, meta).drop("value"), "zone").write.parquet(f"{place}/{kinds[k]}")
        _write_text(spark, f"{out_dir}/{name}/{MANIFEST}", json.dumps(params.manifest(dem_path) | {"meta": vars(meta), "data": data}))
        for x in old:
            if x != name:
                _delete(spark, f"{out_dir}/{x}/{MANIFEST}")
                _delete(spark, f"{out_dir}/{x}")
        _sweep(spark, f"{out_dir}/{name}", data)
    except BaseException:
        if name is not None:
            _delete(spark, f"{out_dir}/{name}/{data}")
            _drop_empty(spark, f"{out_dir}/{name}")
        raise
    finally:
        _delete(spark, f"{out_dir}/{CLAIM}{seq}")
    return name


def _children(spark: SparkSession, path: str) -> list:
    files, place = _fs(spark, path)
    return list(files.listStatus(place)) if files.exists(place) else []


def _drop_empty(spark: SparkSession, path: str) -> None:
    if not _children(spark, path):
        _delete(spark, path)


def _sweep(spark: SparkSession, run: str, data: str | None, before: float = float("inf")) -> None:
    """Removes a run's data folders but the one that its manifest names, if they are older than ``before``."""
    for s in _children(spark, run):
        if s.isDirectory() and s.getPath().getName().startswith("data-") and s.getPath().getName() != data and s.getModificationTime() / 1000 < before:
            _delete(spark, s.getPath().toString())


def recover(spark: SparkSession, out_dir: str, hours: float = 24.0) -> list[str]:
    """Removes claims and data that no manifest names, if they are older than some hours; returns the claims' numbers."""
    before, gone = time.time() - 3600 * hours, []
    whole = set(run_names(spark, out_dir))
    for s in _children(spark, out_dir):
        path, name = s.getPath().toString(), s.getPath().getName()
        if name.startswith(CLAIM) and s.getModificationTime() / 1000 < before:
            _delete(spark, path)
            gone.append(name.removeprefix(CLAIM))
        elif s.isDirectory() and re.fullmatch(r"\d{4}(\+\d+)?", name):
            _sweep(spark, path, _manifest(spark, out_dir, name)["data"] if name in whole else None, before)
            _drop_empty(spark, path)
    return sorted(gone)


def _manifest(spark: SparkSession, out_dir: str, name: str) -> dict:
    return json.loads(spark.read.option("wholetext", "true").text(f"{out_dir}/{name}/{MANIFEST}").first().value)


def latest_path(spark: SparkSession, out_dir: str, patterns: list[str]) -> str | None:
    """Of all that match any of the patterns the path that sorts last; None where nothing does."""
    found = []
    for pattern in patterns:
        files, path = _fs(spark, f"{out_dir}/{pattern}")
        found += [s.getPath().toString() for s in files.globStatus(path) or ()]
    return max(found, default=None)


def prefixed_path(spark: SparkSession, out_dir: str, prefix: str, name: str, suffix: str) -> str | None:
    """The path of a file with a prefix before its name; None where it isn't there."""
    files, path = _fs(spark, f"{out_dir}/{prefix}{name}{suffix}")
    return path.toString() if files.exists(path) else None


def output_path(out_dir: str, name: str, suffix: str, overwrite: bool, now: datetime | None = None) -> str:
    """A fixed name where what is there may be replaced, else one with the time."""
    return f"{out_dir}/{name}{suffix}" if overwrite else f"{out_dir}/{name}_{now or datetime.now():{runs.STAMP}}{suffix}"


def load_run(spark: SparkSession, out_dir: str, name: str | None = None) -> tuple[DataFrame, dict]:
    """Cells and manifest of a run, by default the last."""
    if name is None:
        found = runs.sorted_runs(spark.createDataFrame([(n,) for n in run_names(spark, out_dir)], "name string")).collect()
        if not found:
            raise FileNotFoundError(f"no run in {out_dir}")
        name = found[-1].name
    manifest = _manifest(spark, out_dir, name)
    return read_cells(spark, f"{out_dir}/{name}/{manifest['data']}/cells"), manifest


def integrate(cells: DataFrame, multiplicative: bool = False, **cautions: float) -> DataFrame:
    """The risk index from a run's stored layers; layers that aren't there are left out."""
    found = [F.col(k).cast("double") if k in cells.columns else None for k in ("stability_fs", "twi", "flow_peak")]
    score = (t.multiplicative_risk if multiplicative else t.additive_risk)(*found, **cautions)
    return cells.select("r", "c", score.alias("risk"))


def las_manifest(files: DataFrame) -> DataFrame:
    """Rows (filename, relative) to one JSON text that lists them."""
    return files.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("filename", "relative"))).alias("las"))).alias("value"))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Integrate the layers of a stored run into a risk index.")
    p.add_argument("out_dir")
    p.add_argument("--run")
    p.add_argument("--fs-caution", type=float, default=1.5)
    p.add_argument("--twi-caution", type=float, default=8.0)
    p.add_argument("--flow-caution", type=float, default=0.5)
    p.add_argument("--multiplicative", action="store_true")
    p.add_argument("--no-overwrite", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    cells, _ = load_run(spark, a.out_dir, a.run)
    out = integrate(cells, a.multiplicative, fs_caution=a.fs_caution, twi_caution=a.twi_caution, flow_caution=a.flow_caution)
    out.write.mode("error" if a.no_overwrite else "overwrite").parquet(f"{a.out_dir}/integrated_risk")
    out.groupBy("risk").count().orderBy("risk").show()


if __name__ == "__main__":
    main()
