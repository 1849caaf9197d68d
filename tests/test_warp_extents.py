"""Files in several coordinate systems, and extents against extents."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta
from ridgeline.operators import extents, rasters, tiles, warp


def test_there_and_back(spark):
    """Every known system to degrees and back; known points of the plane and of UTM."""
    places = [(139.7, 35.6), (138.5, 36.0), (140.9, 33.1), (137.2, 38.4)]
    df = spark.createDataFrame(places, "lon double, lat double")
    for epsg in (3857, 32654, 32754, 6675, 6676, 6677, 6669 + 18):
        x, y = rasters.reprojected(F.col("lon"), F.col("lat"), 4326, epsg)
        there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = rasters.reprojected(F.col("x"), F.col("y"), epsg, 4326)
        for r in there.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            far = epsg == 6669 + 18  # the zone lies 15 degrees off
            assert r.a == pytest.approx(r.lon, abs=1e-5 if far else 1e-7) and r.b == pytest.approx(r.lat, abs=1e-5 if far else 1e-7)
    x, y = rasters.reprojected(F.lit(138.5), F.lit(36.0), 4326, 6676)
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(got.x) < 1e-6 and abs(got.y) < 1e-6
    with pytest.raises(ValueError):
        rasters.reprojected(F.lit(0.0), F.lit(0.0), 27700, 4326)
    with pytest.raises(ValueError):
        rasters.reprojected(F.lit(0.0), F.lit(0.0), 4326, 27700)


def test_mixed_systems_as_one_grid(spark):
    """A field that is a function of the place, cut into files of three systems, comes back as that function."""
    field = lambda lon, lat: 1000 * (lon - 139.7) + 500 * (lat - 35.6)
    w = 20037508.342789244
    metas = {"a": GridMeta(30, 40, 10.0, 139.7 / 180 * w, 4247000.0, 10.0, -10.0, 3857), "b": GridMeta(25, 30, 8.0, 108700.0, -44200.0, 8.0, -8.0, 6676), "c": GridMeta(20, 20, 9.0, 382300.0, 3940900.0, 9.0, -9.0, 32654)}
    catalogue = warp.catalogue_of(spark, metas)
    frames = []
    for name, m in metas.items():
        cells = spark.range(m.rows * m.cols).select(F.lit(name).alias("path"), (F.col("id") / m.cols).cast("int").alias("r"), (F.col("id") % m.cols).cast("int").alias("c"))
        lon, lat = rasters.reprojected(m.x(), m.y(), m.epsg, 4326)
        frames.append(cells.withColumns({"lon": lon, "lat": lat}).select("path", "r", "c", field(F.col("lon"), F.col("lat")).alias("z")))
    cells = frames[0].unionByName(frames[1]).unionByName(frames[2])
    merged, meta = warp.merge_mixed(cells, catalogue, 6676, 7.0)
    lon, lat = rasters.reprojected(meta.x(), meta.y(), 6676, 4326)
    off = merged.withColumns({"lon": lon, "lat": lat}).select(F.abs(F.col("z") - field(F.col("lon"), F.col("lat"))).alias("d"), "r", "c").agg(F.max("d"), F.count("*"), F.min("r"), F.min("c"), F.max("r"), F.max("c")).first()
    assert off[0] < 0.15  # nearest cell: half of 10 m is 0.06 degrees of a thousandth
    assert off[2] >= 0 and off[3] >= 0 and off[4] < meta.rows and off[5] < meta.cols and off[1] > 3000
    # No gap: each file's own cells, taken to the target, have a value there.
    got = {(r.r, r.c) for r in merged.collect()}
    for name, m in metas.items():
        x, y = rasters.reprojected(m.x(), m.y(), m.epsg, 4326)
        centres = spark.range(m.rows * m.cols).select((F.col("id") / m.cols).cast("int").alias("r"), (F.col("id") % m.cols).cast("int").alias("c")).filter((F.col("r") > 0) & (F.col("c") > 0) & (F.col("r") < m.rows - 1) & (F.col("c") < m.cols - 1)).select(x.alias("lon"), y.alias("lat"))
        e, n = rasters.reprojected(F.col("lon"), F.col("lat"), 4326, 6676)
        for r in centres.select(e.alias("e"), n.alias("n")).collect():
            assert (math.floor((r.n - meta.y0) / meta.py), math.floor((r.e - meta.x0) / meta.px)) in got, name
    with pytest.raises(ValueError):
        warp.mixed_meta(catalogue.limit(0), 6676, 1.0)


def _made(plan, node="Generate", metric="numOutputRows") -> int:
    """Rows that the plan's explosions (or other nodes) made, after it has run."""
    while (kind := plan.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        plan = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan()
    own = plan.metrics().apply(metric).value() if plan.nodeName() == node else 0
    return own + sum(_made(plan.children().apply(i), node, metric) for i in range(plan.children().size()))


def test_warp_asks_for_a_long_file_by_blocks(spark):
    """A long file that lies aslant on the target: the cells that each centre is in, without those of the whole bound."""
    meta = GridMeta(6000, 5, 5.0, 15551000.0, 4244000.0, 5.0, -5.0, 3857)
    target = rasters.utm_target(spark, meta, 54, 4.0)
    cells = spark.range(meta.rows * meta.cols).select(F.lit("a").alias("path"), F.floor(F.col("id") / meta.cols).cast("int").alias("r"), (F.col("id") % meta.cols).cast("int").alias("c"), F.col("id").alias("z"))
    got = warp.warped(cells, warp.catalogue_of(spark, {"a": meta}), target)
    rows = sorted((r.r, r.c, r.z) for r in got.collect())
    assert meta.rows < _made(got._jdf.queryExecution().executedPlan()) < 8 * meta.rows * meta.cols < target.rows * target.cols
    whole = spark.range(target.rows * target.cols).select(F.floor(F.col("id") / target.cols).cast("int").alias("r"), (F.col("id") % target.cols).cast("int").alias("c"))
    x, y = rasters.reprojected(target.x(), target.y(), 32654, 3857)
    at = whole.withColumns({"x": x, "y": y}).toPandas()
    sr, sc = np.floor((at.y - meta.y0) / meta.py), np.floor((at.x - meta.x0) / meta.px)
    held = (sr >= 0) & (sr < meta.rows) & (sc >= 0) & (sc < meta.cols)
    assert rows == sorted((int(r), int(c), int(z)) for r, c, z in zip(at.r[held], at.c[held], (sr * meta.cols + sc)[held], strict=True)) and len(rows) > 25000


def test_reproject_deals_out_only_what_the_grid_covers(spark):
    """A long grid that lies aslant, with an absent and an unknown cell: every target cell, four known cells or null."""
    meta = GridMeta(3000, 70, 5.0, 15551000.0, 4244000.0, 5.0, -5.0, 3857)
    target = rasters.utm_target(spark, meta, 54, 4.0)
    target = GridMeta(target.rows, target.cols + 200, 4.0, target.x0 - 400, target.y0, 4.0, -4.0, 32654)
    k = F.col("id")
    grid = spark.range(meta.rows * meta.cols).filter(k != 70 * 1500 + 30).select(F.floor(k / meta.cols).cast("int").alias("r"), (k % meta.cols).cast("int").alias("c"), F.when(k != 70 * 64 + 64, k % 1013).alias("z"))
    got = rasters.reproject_to_utm(grid, meta, 54, target)
    rows = got.toPandas().sort_values(["r", "c"])
    assert len(rows) == target.rows * target.cols == len(rows[["r", "c"]].drop_duplicates())
    x, y = rasters.reprojected(target.x(), target.y(), 32654, 3857)
    at = spark.range(target.rows * target.cols).select(F.floor(k / target.cols).cast("int").alias("r"), (k % target.cols).cast("int").alias("c")).withColumns({"x": x, "y": y}).toPandas().sort_values(["r", "c"])
    z = (np.arange(meta.rows * meta.cols) % 1013).astype(float).reshape(meta.rows, meta.cols)
    z[1500, 30] = z[64, 64] = np.nan
    fr, fc = ((at.y - meta.y0) / meta.py - 0.5).to_numpy(), ((at.x - meta.x0) / meta.px - 0.5).to_numpy()
    r0, c0 = np.floor(fr).astype(int), np.floor(fc).astype(int)
    held = (r0 >= 0) & (r0 < meta.rows - 1) & (c0 >= 0) & (c0 < meta.cols - 1)
    r, c, v, u = r0[held], c0[held], (fr - r0)[held], (fc - c0)[held]
    want = np.full(len(at), np.nan)
    want[held] = z[r, c] * (1 - v) * (1 - u) + z[r, c + 1] * (1 - v) * u + z[r + 1, c] * v * (1 - u) + z[r + 1, c + 1] * v * u
    assert np.allclose(rows.z.to_numpy(dtype=float), want, atol=1e-6, equal_nan=True) and 200_000 < np.isfinite(want).sum() < held.sum()
    got._jdf.queryExecution().toRdd().count()
    assert _made(got._jdf.queryExecution().executedPlan(), "Exchange", "shuffleRecordsWritten") < 3 * meta.rows * meta.cols < target.rows * target.cols


BOX = "xmin double, ymin double, xmax double, ymax double"


def test_overlap_join(spark):
    rng = np.random.default_rng(3)

    def boxes(n, scale):
        low = rng.uniform(-50, 50, (n, 2)).round(1)
        size = (scale ** rng.uniform(-3, 3, (n, 2))).round(1)  # from points to far larger than all
        return [(float(a), float(b), float(a + w), float(b + h)) for (a, b), (w, h) in zip(low, size, strict=True)]

    left = boxes(120, 6.0) + [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 3.0, 3.0), (-1e9, -1e9, 1e9, 1e9), (None, 0.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0), (5.0, 5.0, 4.0, 6.0)]
    right = boxes(90, 6.0) + [(0.0, 0.0, 1.0, 1.0), (3.0, 3.0, 8.0, 8.0), (3.0, 3.0, 8.0, 8.0), (3.00001, 0.0, 4.0, 9.0)]
    a = spark.createDataFrame([(i, *b) for i, b in enumerate(left)], f"k int, {BOX}")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], f"v int, {BOX}")
    joined = extents.overlap_join(a, b)
    known = lambda x: None not in x and not any(map(math.isnan, x)) and x[0] <= x[2] and x[1] <= x[3]
    want = sorted((i, j) for i, p in enumerate(left) for j, q in enumerate(right) if known(p) and known(q) and not (p[2] < q[0] or p[0] > q[2] or p[3] < q[1] or p[1] > q[3]))
    assert sorted((r.k, r.v) for r in joined.collect()) == want and len(want) > 400
    assert set(joined.columns) == {"k", "v", "xmin", "ymin", "xmax", "ymax", "right_xmin", "right_ymin", "right_xmax", "right_ymax"}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert extents.overlap_join(a.limit(0), b).count() == 0 == extents.overlap_join(a, b.limit(0)).count()


def test_crowded_buckets_are_cut(spark, monkeypatch):
    """A million pairs of one place are shared by the tasks, each pair once; other buckets stay whole."""
    monkeypatch.setattr(extents, "BLOCK_PAIRS", 10_000, raising=False)
    box = lambda at: [at.alias("xmin"), at.alias("ymin"), (at + 0.5).alias("xmax"), (at + 0.5).alias("ymax")]
    there = F.when(F.col("id") < 1000, 0.25 + F.col("id") / 1e5).otherwise(F.col("id") * 8.0)
    a, b = (spark.range(1010).select(F.col("id").alias(k), *box(there)) for k in "kv")
    joined = extents.overlap_join(a, b)
    joins = re.findall(r"(\w+Join) \[[^]]*\], \[[^]]*\], (\w+)", joined._jdf.queryExecution().executedPlan().toString())
    assert {how for how, kind in joins if kind == "Inner"} == {"SortMergeJoin"}  # exploded rows are not broadcast
    tasks = {r[0]: r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()}
    assert sum(tasks.values()) == 1_000_010 and max(tasks.values()) < 600_000
    assert joined.select("k", "v").distinct().count() == 1_000_010


def _degrees(spark, n):
    """n extents of some tiles each, and a table of tiles that is too large to broadcast."""
    at = spark.range(n).select(F.col("id").alias("ext_id"), (F.lit(138.0) + F.col("id") % 7 * 0.01).alias("xmin"), (F.lit(35.0) + F.col("id") % 5 * 0.01).alias("ymin"))
    return at.withColumns({"xmax": F.col("xmin") + 0.01, "ymax": F.col("ymin") + 0.01}), spark.range(1 << 30).select(F.lit("DEM1A 1m").alias("source"), F.col("id").alias("tx"), F.col("id").alias("ty"))


def test_covers_are_not_broadcast(spark):
    """Tiles of extents are many more bytes than the extents, which Spark doesn't see."""
    plan = tiles.finest_cover(*_degrees(spark, 50), tiles.registry(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan


def test_sources_of_extents_are_not_broadcast(spark):
    plan = tiles.source_of_extents(*_degrees(spark, 50), tiles.registry(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan
    extents_ = _degrees(spark, 3)[0].withColumn("xmin", F.col("xmin") - F.when(F.col("ext_id") == 2, 5).otherwise(0)).withColumn("xmax", F.col("xmin") + 0.001)
    x, y = tiles.tile_of(F.col("xmin"), F.col("ymax"), 15)
    there = extents_.filter("ext_id < 2").select(F.lit("DEM5A 5m").alias("source"), x.alias("tx"), y.alias("ty"))
    got = {r.ext_id: (r.source, r.found) for r in tiles.source_of_extents(extents_.union(extents_), there.union(there), tiles.registry(spark)).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "DEM5A 5m", 1: "DEM5A 5m", 2: None} and got[2][1] is None
