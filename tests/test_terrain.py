"""Grid operators against plain numpy written from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import terrain as t
from ridgeline.grid import GridMeta, densify
from ridgeline.operators import drainage, outlines, rasters, stencil, zones
from ridgeline.plans.analysis import AnalysisParams, analyse, drained, terrain


def frame(spark, z):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "r int, c int, z double").repartition(3), GridMeta(*z.shape, 2.0)


def array(df, shape, value):
    out = np.full(shape, np.nan)
    for r in df.select("r", "c", F.col(value).cast("double").alias("v")).collect():
        out[r.r, r.c] = np.nan if r.v is None else r.v
    return out


def surface(seed, shape=(9, 11), holes=0.08):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 1, shape) + np.arange(shape[1]) * 0.7
    z[rng.random(shape) < holes] = np.nan
    return z


def at(z, r, c, edge):
    n, m = z.shape
    if edge:
        return z[min(max(r, 0), n - 1), min(max(c, 0), m - 1)]
    return z[r, c] if 0 <= r < n and 0 <= c < m else np.nan


def plain_d8(z):
    out = np.zeros(z.shape)
    for r, c in np.ndindex(*z.shape):
        best = 0.0
        for code, dr, dc, d in stencil.D8:
            s = (z[r, c] - at(z, r + dr, c + dc, False)) / d
            if s > best:
                best, out[r, c] = s, code
    return out


def plain_receivers(fdir):
    step = {code: (dr, dc) for code, dr, dc, _ in stencil.D8}
    return {(r, c): (r + step[f][0], c + step[f][1]) for (r, c), f in np.ndenumerate(fdir) if f}


SHAPES = [(9, 11), (1, 1), (1, 6), (7, 1), (2, 2), (30, 23)]


@pytest.mark.parametrize("shape", SHAPES)
def test_stencils(spark, shape):
    z = surface(1, shape)
    df, meta = frame(spark, z)
    gx, gy, bend = (np.full(shape, np.nan) for _ in range(3))
    for r, c in np.ndindex(*shape):
        w, e, n, s = (at(z, r + a, c + b, True) for a, b in ((0, -1), (0, 1), (-1, 0), (1, 0)))
        if not np.isnan(z[r, c]):
            gx[r, c], gy[r, c] = (e - w) / 4, (s - n) / 4
            bend[r, c] = -((e - 2 * z[r, c] + w) / 4 + (s - 2 * z[r, c] + n) / 4)
    assert np.allclose(array(stencil.slope(df, meta), shape, "slope"), np.degrees(np.arctan(np.hypot(gx, gy))), equal_nan=True)
    assert np.allclose(array(stencil.curvature(df, meta), shape, "curvature"), bend, equal_nan=True)
    rough = np.full(shape, np.nan)
    for r, c in np.ndindex(*shape):
        near = [at(bend, r + a, c + b, True) for a in range(-2, 3) for b in range(-2, 3)]
        near = [v for v in near if not np.isnan(v)]
        if not np.isnan(z[r, c]):
            rough[r, c] = np.std(near) if len(near) > 1 else 0.0
    assert np.allclose(array(stencil.surface_complexity(df, meta), shape, "shc"), rough, atol=1e-6, equal_nan=True)
    assert np.array_equal(array(stencil.flow_direction(df), shape, "fdir"), plain_d8(z))


def test_direction_ties(spark):
    z = np.array([[9, 1, 9], [9, 5, 1], [9, 9, 9.0]])
    df, _ = frame(spark, z)
    assert array(stencil.flow_direction(df), z.shape, "fdir")[1, 1] == 64  # north before east
    df, _ = frame(spark, np.full((3, 3), 4.0))
    assert not array(stencil.flow_direction(df), (3, 3), "fdir").any()


@pytest.mark.parametrize("shape", [(9, 11), (3, 4), (1, 5)])
def test_blur(spark, shape):
    z = surface(3, shape)
    df, meta = frame(spark, z)
    k = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    k /= k.sum()
    v = np.nan_to_num(z)
    for axis in (1, 0):
        v = np.apply_along_axis(lambda line: np.convolve(np.pad(line, 8, mode="symmetric"), k, "valid"), axis, v)
    assert np.allclose(array(stencil.gaussian_blur(df, meta, "z"), shape, "blurred"), np.where(np.isnan(z), np.nan, v), equal_nan=True)


@pytest.mark.parametrize("seed,holes,tile", [(1, 0.08, 256), (2, 0.0, 3), (3, 0.05, 4), (4, 0.0, 1)])
def test_drainage(spark, seed, holes, tile, monkeypatch):
    monkeypatch.setattr(drainage, "TILE", tile)
    z = surface(seed, (14, 17), holes)
    df, meta = frame(spark, z)
    to = plain_receivers(plain_d8(z))
    order = sorted((k for k in np.ndindex(*z.shape) if not np.isnan(z[k])), key=lambda k: -z[k])
    accum, weight = np.ones(z.shape), np.arange(z.size, dtype=float).reshape(z.shape)
    total = weight.copy()
    for k in order:
        if k in to:
            accum[to[k]] += accum[k]
            total[to[k]] += total[k]
    cells = drained(df.withColumn("w", (F.col("r") * 17 + F.col("c")).cast("double")), meta, ["w"])
    cells = cells.withColumn("hours", t.travel_hours(F.col("dzdx"), F.col("dzdy"), F.col("fdir"), meta.cell))
    assert np.array_equal(array(cells, z.shape, "accum"), accum)
    assert np.array_equal(array(cells, z.shape, "accum_w"), total)
    roots = [k for k in order if k not in to]
    assert sum(accum[k] for k in roots) == len(order)
    hours = array(cells, z.shape, "hours")
    cum = hours.copy()
    for k in reversed(order):
        if k in to:
            cum[k] = hours[k] + cum[to[k]]
    most = cum.copy()
    for k in order:
        if k in to and most[k] > most[to[k]]:
            most[to[k]] = most[k]
    got = array(drainage.concentration_hours(cells, meta), z.shape, "tc")
    assert np.allclose(got, most - cum, equal_nan=True)
    both = drainage.drain(cells.drop("accum", "accum_w"), meta, ["w"], "hours")
    assert np.allclose(array(both, z.shape, "tc"), most - cum, equal_nan=True) and np.array_equal(array(both, z.shape, "accum_w"), total)


def test_formulas(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.05, 4.0), (30.0, 10.0), (None, 5.0)], "slope double, accum double")
    rows = df.select(t.safety_factor(F.col("slope")).alias("fs"), t.wetness_index(F.col("accum"), F.col("slope"), 2.0).alias("twi")).collect()
    assert rows[0].fs == math.inf and rows[3].fs is None and rows[3].twi is None
    s = math.radians(30)
    assert rows[2].fs == pytest.approx((18 - 4.905) * math.cos(s) ** 2 * math.tan(math.radians(35)) / (18 * math.sin(s) * math.cos(s)))
    assert rows[1].twi == pytest.approx(math.log(16 / math.tan(math.radians(0.1))))
    c, v = t.canopy_coefficients(F.col("h"))
    got = spark.createDataFrame([(None,), (0.0,), (6.5,), (50.0,)], "h double").select(c.alias("c"), v.alias("v")).collect()
    assert [round(r.c, 5) for r in got] == [0.15, 0.55, 0.35, 0.15] and [round(r.v, 5) for r in got] == [0.3, 0.6, 0.45, 0.3]


def test_risk_thresholds(spark):
    df = spark.createDataFrame([(0.99, 8.0, 1.0), (1.0, 7.9, 0.5), (1.5, None, 0.4), (None, None, None), (math.inf, 9.0, None)], "fs double, twi double, flow double")
    layer = [F.col(k) for k in ("fs", "twi", "flow")]
    rows = df.select(t.additive_risk(*layer).alias("a"), t.multiplicative_risk(*layer).alias("m"), t.additive_risk(F.col("fs"), None, None).alias("f")).collect()
    assert [r.a for r in rows] == [6, 3, 0, None, 1] and [r.m for r in rows] == [32, 4, 1, None, 2] and [r.f for r in rows] == [3, 2, 0, None, 0]
    with pytest.raises(FileNotFoundError):
        t.additive_risk(None, None, None)


def test_whole_analysis(spark):
    z = surface(5, (12, 10), 0.05)
    df, meta = frame(spark, z)
    cells = analyse(df.withColumn("cs", F.lit(5.0)), meta, AnalysisParams(flow=True), canopy="cs")
    assert cells.count() == z.size and {"stability_fs", "twi", "tc", "flow_peak", "integrated_risk_index", "shc"} <= set(cells.columns)
    assert cells.filter("z IS NULL AND integrated_risk_index IS NULL").isEmpty()  # discharge exists on nodata
    masked = analyse(df, meta, AnalysisParams(flow=True, mask_nodata=True))
    assert masked.filter("z IS NULL AND integrated_risk_index IS NOT NULL").isEmpty()
    with pytest.raises(ValueError):
        analyse(df, meta, AnalysisParams(stability=False, valley=False))
    assert AnalysisParams().manifest("d")["analyses"] == ["stability", "valley"] and "runoff" not in AnalysisParams().manifest("d")


def plain_zones(mask):
    label = {k: k for k in zip(*np.nonzero(mask), strict=True)}
    moved = True
    while moved:
        moved = False
        for r, c in label:
            for k in ((r + 1, c), (r, c + 1), (r - 1, c), (r, c - 1)):
                if k in label and label[k] < label[r, c]:
                    label[r, c], moved = label[k], True
    return {k: int(v[0] * mask.shape[1] + v[1]) for k, v in label.items()}


def test_zones(spark):
    mask = np.random.default_rng(2).random((13, 12)) < 0.55
    mask[0, :] = mask[:, 0] = mask[12, :] = mask[:, 11] = True
    df, meta = frame(spark, np.where(mask, 1.0, 0.0))
    labelled = zones.label_zones(df.filter("z = 1"), meta)
    truth = plain_zones(mask)
    assert {(r.r, r.c): r.zone for r in labelled.collect()} == truth
    stats = {r.zone: r for r in zones.zone_statistics(labelled, meta).collect()}
    assert sum(r.n_cells for r in stats.values()) == mask.sum()
    for r in outlines.zone_outlines(labelled, meta).collect():
        rings = [[tuple(map(float, p.split())) for p in ring.strip("()").split(", ")] for ring in r.wkt.removeprefix("POLYGON (").removesuffix(")").split("), (")]
        areas = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(x, x[1:], strict=False))) / 2 for x in rings]
        # The grid's pixels are 1 x 1 in coordinates; holes come off the outer ring.
        assert areas[0] - sum(areas[1:]) == pytest.approx(stats[r.zone].n_cells)
        assert all(x[0] == x[-1] for x in rings)
    assert zones.label_zones(df.filter("z = 7"), meta).count() == 0


def plain_rings(label):
    """Rings of each zone by following sides one by one: zone, corners, perimeter, twice the area."""
    rows, cols = label.shape
    at = lambda r, c: label[r, c] if 0 <= r < rows and 0 <= c < cols else 0
    facing, ends, out = ((-1, 0), (0, 1), (1, 0), (0, -1)), ((0, 1), (1, 1), (1, 0), (0, 0)), []
    left = {(r, c, d) for r in range(rows) for c in range(cols) if label[r, c] for d, (dr, dc) in enumerate(facing) if at(r + dr, c + dc) != label[r, c]}
    while left:
        first = r, c, d = min(left, key=lambda s: (s[0] * cols + s[1]) * 4 + s[2])
        ring, points = first, []
        while True:
            left.discard((r, c, d))
            points.append((r + ends[d][0], c + ends[d][1]))
            (dr, dc), (hr, hc), z = facing[d], facing[(d + 1) % 4], label[r, c]
            r, c, d = (r, c, (d + 1) % 4) if at(r + hr, c + hc) != z else (r + hr + dr, c + hc + dc, (d + 3) % 4) if at(r + hr + dr, c + hc + dc) == z else (r + hr, c + hc, d)
            if (r, c, d) == first:
                break
        n = len(points)
        corners = [p for k, p in enumerate(points) if not (points[k - 1][0] == p[0] == points[(k + 1) % n][0] or points[k - 1][1] == p[1] == points[(k + 1) % n][1])]
        area2 = sum(points[k - 1][1] * points[k][0] - points[k][1] * points[k - 1][0] for k in range(n))
        out.append((int(label[ring[0], ring[1]]), (ring[0] * cols + ring[1]) * 4 + ring[2], len(corners), n, area2, corners))
    return out


@pytest.mark.parametrize("tile,density", [(4, 0.6), (5, 0.9), (64, 0.55)])
def test_outlines_by_tiles(spark, tile, density):
    rng = np.random.default_rng(tile)
    mask = rng.random((23, 31)) < density
    mask[3, 2:30] = mask[20, 2:30] = mask[3:21, 2] = mask[3:21, 29] = True  # one ring around most of it, over many tiles
    meta = GridMeta(23, 31, 2.0, 100.0, 900.0, 2.0, -2.0)
    # Zones that aren't connected, and neighbours of another zone.
    label = np.where(mask, 7 + 3 * (np.arange(31) // 20)[None, :] - 20 * (np.arange(23) > 18)[:, None], 0)
    rows = [(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(label) if v]
    df = spark.createDataFrame(rows + rows[:5], "r int, c int, zone long")
    parts = outlines.ring_parts(df, meta, tile)
    want = plain_rings(label)
    got = sorted((r.zone, r.ring, r.corners, r.perimeter, r.area) for r in outlines.zone_rings(parts, meta).collect())
    assert got == sorted((z, k, corners, 2.0 * n, 2.0 * a) for z, k, corners, n, a, _ in want)
    cells = {z: 0 for z, *_ in want} | {int(z): int((label == z).sum()) for z in np.unique(label) if z}
    for z, n in cells.items():
        assert sum(x[4] for x in got if x[0] == z) == 4.0 * n
    if tile < 20:
        assert parts.groupBy("ring").count().agg(F.max("count")).first()[0] > 8
    # The same corners in the same cyclic order, as rows and as text.
    walked = {}
    for r in outlines.ring_corners(parts, meta).orderBy("ring", "place", "k").collect():
        walked.setdefault(r.ring, []).append((round((900.0 - r.y) / 2), round((r.x - 100.0) / 2)))
    for _, k, _, _, _, corners in want:
        at = corners.index(walked[k][0])
        assert any(corners[i:] + corners[:i] == walked[k] for i in range(at, len(corners)) if corners[i] == walked[k][0])
    texts = {r.zone: r.wkt for r in outlines.zone_outlines(df, meta, tile).collect()}
    for z in cells:
        rings = [[tuple(map(float, p.split())) for p in ring.strip("()").split(", ")] for ring in texts[z].removeprefix("POLYGON (").removesuffix(")").split("), (")]
        assert all(x[0] == x[-1] for x in rings)
        areas = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(x, x[1:], strict=False)) / 2 for x in rings]
        assert abs(sum(areas)) == pytest.approx(4.0 * cells[z]) and abs(areas[0]) == max(map(abs, areas))
    assert outlines.ring_parts(df.limit(0), meta, tile).count() == 0


def test_clip_resample_mosaic(spark):
    z = surface(6, (12, 15), 0.1)
    df, _ = frame(spark, z)
    meta = GridMeta(12, 15, 1.0, 100.0, 50.0, 1.0, -1.0)
    cut, part = rasters.clip(df, meta, 102.5, 41.2, 108.9, 48.0)
    assert (part.x0, part.y0, part.rows, part.cols) == (102.0, 48.0, 6, 6)
    assert np.allclose(array(cut, (6, 6), "z"), z[2:8, 2:8], equal_nan=True)
    with pytest.raises(ValueError):
        rasters.clip(df, meta, 500, 500, 600, 600)
    out, m = rasters.resample(df, meta, 4.0)
    with np.errstate(all="ignore"):
        mean = np.nanmean(z[:12, :12].reshape(3, 4, 3, 4), axis=(1, 3))
    assert np.allclose(array(out, (3, 3), "z"), mean) and m.cell == pytest.approx(15 / 3)
    out, m = rasters.resample(df, meta, 1.7)
    n, k = m.rows, m.cols
    rr, cc = np.linspace(0, 11, n), np.linspace(0, 14, k)
    lay = lambda v: np.array([[np.interp(c, range(15), [np.interp(r, range(12), v[:, j]) for j in range(15)]) for c in cc] for r in rr])
    want = np.where(lay(np.isnan(z).astype(float)) > 0.5, np.nan, lay(np.nan_to_num(z)))
    assert np.allclose(array(out, (n, k), "z"), want, equal_nan=True)
    a, b = df.withColumn("src_ord", F.lit(0)), df.filter("c < 5").select("r", "c", F.when(F.col("r") != 3, 1.0).alias("z")).withColumn("src_ord", F.lit(1))
    got, want = array(rasters.mosaic(a.unionByName(b)), z.shape, "z"), z.copy()
    want[:, :5] = np.where(np.arange(12)[:, None] == 3, z[:, :5], 1.0)
    assert np.allclose(got, want, equal_nan=True)
    assert densify(spark, df.filter("c > 3"), meta).count() == z.size
    assert rasters.auto_resample(df, meta)[1] is meta and rasters.auto_resample(df, meta.with_cell(0.1))[1].cols == 3
    assert rasters.canopy_height(df, meta, df, GridMeta(1, 1)) is None
    with pytest.raises(ValueError):
        rasters.check_area(GridMeta(1000, 1000, 1.0), 50.0)


def test_projection_round_trip(spark):
    lon, lat = F.col("lon"), F.col("lat")
    df = spark.createDataFrame([(138.4, 34.9), (140.9, 36.1), (135.2, 35.7)], "lon double, lat double")
    e, n = rasters.transverse_mercator(lon, lat, 141.0)
    back = df.select("lon", "lat", e.alias("e"), n.alias("n")).select("lon", "lat", "e", "n", *[v.alias(k) for v, k in zip(rasters.utm_lonlat(F.col("e"), F.col("n"), 54), ("x", "y"), strict=True)])
    for r in back.collect():
        assert r.x == pytest.approx(r.lon, abs=1e-7) and r.y == pytest.approx(r.lat, abs=1e-7)
    mx, my = rasters.lonlat_mercator(lon, lat)
    x, y = rasters.mercator_lonlat(F.col("a"), F.col("b"))
    for r in df.select("lon", "lat", mx.alias("a"), my.alias("b")).select("lon", "lat", x.alias("x"), y.alias("y")).collect():
        assert r.x == pytest.approx(r.lon) and r.y == pytest.approx(r.lat)


def test_plan_has_two_exchanges(spark):
    df, meta = frame(spark, surface(1))
    plan = terrain(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("o_totalprice").alias("z")), meta)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Python" not in plan


def test_utm_target_covers_the_source(spark):
    for rows in (10, 700):
        source = GridMeta(rows, 150, 5.0, 15551000.0, 4244000.0, 5.0, -5.0, 3857)
        target = rasters.utm_target(spark, source, 54, 4.0)
        cells = spark.range(rows * 150).select((F.col("id") / 150).cast("int").alias("r"), (F.col("id") % 150).cast("int").alias("c"))
        e, n = rasters.transverse_mercator(*rasters.mercator_lonlat(source.x(), source.y()), 141.0)
        b = cells.select(e.alias("e"), n.alias("n")).agg(F.min("e"), F.max("e"), F.min("n"), F.max("n")).first()
        xmin, ymin, xmax, ymax = target.extent
        assert 0 <= b[0] - xmin < 12 and 0 <= xmax - b[1] < 12 and 0 <= b[2] - ymin < 12 and 0 <= ymax - b[3] < 12
