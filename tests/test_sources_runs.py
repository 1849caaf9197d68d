"""Files, stored runs, tiles, streams and run names."""

import io
import re
import struct
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.functions import style
from ridgeline.functions import tiles as tf
from ridgeline.grid import GridMeta, cell_metres
from ridgeline.operators import points as pt
from ridgeline.operators import rasters, runs, tiles
from ridgeline.operators.rasters import merge, rebase
from ridgeline.plans import store
from ridgeline.plans.analysis import AnalysisParams, analyse
from ridgeline.sources import bundle
from ridgeline.sources import cells as store_cells
from ridgeline.sources import files, onefile
from ridgeline.sources import raster as rs
from ridgeline.streaming import landing


def grid(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "r int, c int, z double")


def test_geotiff_round_trip(spark, tmp_path):
    z = np.random.default_rng(0).normal(size=(23, 17)).astype("f4").astype(float)
    z[3, 4] = np.nan
    z[5, 6] = np.inf
    meta = GridMeta(23, 17, 0.5, 100.0, 900.0, 0.5, -0.5, 6676)
    paths = [r.path for r in rs.write_geotiff(grid(spark, z), meta, str(tmp_path), "dem", tile=10).collect()]
    assert len(paths) == 6
    got = {(r.path[-15:-10], r.path[-9:-4], r.r, r.c): r.z for r in rs.read_geotiff(spark, f"{tmp_path}/*.tif").collect()}
    assert len(got) == z.size
    for (i, k, r, c), v in got.items():
        want = z[int(i) * 10 + r, int(k) * 10 + c]
        assert (v is None and np.isnan(want)) or v == want
    first = rs.raster_catalog(spark, f"{tmp_path}/*.tif").first()
    assert (first.rows, first.cols, first.epsg, first.xmin, first.ymax) == (10, 10, 6676, 100.0, 900.0)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as f:
        f.writestr("notes.md", "x")
        f.write(paths[0], "sub/a.TIF")
        f.writestr("b_dem.txt", "1 2 3")
    assert rs.zip_members(spark, f"{tmp_path}/a.zip").first().member == "sub/a.TIF"
    assert rs.read_zipped(spark, f"{tmp_path}/a.zip")[0].count() == 100
    cells, catalogue = rs.read_geotiff(spark, f"{tmp_path}/*.tif"), rs.raster_catalog(spark, f"{tmp_path}/*.tif")
    whole, merged = merge(cells, catalogue)
    assert merged == meta
    assert {(r.r, r.c): r.z for r in whole.collect()} == {(r, c): None if np.isnan(v) else v for (r, c), v in np.ndenumerate(z)}
    (tmp_path / "bad.tif").write_bytes(b"nonsense")
    assert rs.raster_catalog(spark, f"{tmp_path}/bad.tif").first().rows is None


def tiff(pixels, tags, big=False, predictor=1):
    """A raw TIFF of one strip, classic or large, with further tags (number, kind, values)."""
    body = pixels.tobytes()
    code = {"H": 3, "I": 4, "d": 12}
    size = pixels.dtype.itemsize
    head, wide = (16, 8) if big else (8, 4)
    all_tags = sorted([(256, "I", (pixels.shape[1],)), (257, "I", (pixels.shape[0],)), (258, "H", (8 * size,)), (259, "H", (1,)), (273, "I", (head,)), (277, "H", (1,)), (278, "I", (pixels.shape[0],)), (279, "I", (len(body),)), (317, "H", (predictor,)), (339, "H", ({"i": 2, "u": 1, "f": 3}[pixels.dtype.kind],)), *tags])
    at = head + len(body)
    extra_at = at + (8 if big else 2) + len(all_tags) * (20 if big else 12) + wide
    entries = extra = b""
    for tag, kind, values in all_tags:
        data = struct.pack(f"<{len(values)}{kind}", *values)
        if len(data) > wide:
            field = struct.pack("<Q" if big else "<I", extra_at + len(extra))
            extra += data
        else:
            field = data.ljust(wide, b"\0")
        entries += struct.pack("<HHQ" if big else "<HHI", tag, code[kind], len(values)) + field
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return start + body + struct.pack("<Q" if big else "<H", len(all_tags)) + entries + b"\0" * wide + extra


def test_large_tiff_and_predictors():
    rng = np.random.default_rng(2)
    z = rng.integers(-3000, 3000, (5, 7)).astype("<i2")
    assert np.array_equal(rs.tiff_pixels(tiff(z, [], big=True)), z)
    steps = np.diff(z, axis=1, prepend=np.int16(0)).astype("<i2")
    assert np.array_equal(rs.tiff_pixels(tiff(steps, [], predictor=2)), z)
    f = rng.normal(size=(4, 6)).astype("<f4")
    planes = f.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    stored = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    assert np.array_equal(rs.tiff_pixels(tiff(np.ascontiguousarray(stored).view("<f4"), [], predictor=3)), f)


def test_cells_in_metres():
    z = np.zeros((10, 10), "<f4")
    place = [(33550, "d", (0.001, 0.001, 0.0)), (33922, "d", (0.0, 0.0, 0.0, 138.0, 60.005, 0.0))]
    degrees, _ = rs.tiff_meta(tiff(z, [*place, (34735, "H", (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326))]))
    assert degrees.epsg == 4326 and degrees.cell == pytest.approx(0.001 * 111320 * 0.5, rel=1e-3) and degrees.px == 0.001
    metres, _ = rs.tiff_meta(tiff(z, [*place, (34735, "H", (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 6676))]))
    assert metres.cell == 0.001
    world, _ = rs.tiff_meta(tiff(z, []), "0.5\n0\n0\n-0.5\n100.25\n899.75\n")
    assert (world.x0, world.y0, world.px, world.py) == (100.0, 900.0, 0.5, -0.5)


def test_zipped_texts_and_merge(spark, tmp_path):
    """Neighbouring survey tiles, one as XYZ and one as a TIFF with a world file, as one grid; the last name wins in an archive."""
    xyz = "".join(f"{c * 0.5 + 0.25} {r * 0.5 + 0.25} {10 * r + c}\n" for r in range(4) for c in range(4))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as f:
        f.writestr("old.txt", "0.25 0.25 1\n")
        f.writestr("x_dem.txt", xyz)
    z = np.arange(16, dtype="<f4").reshape(4, 4) + 100
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as f:
        f.writestr("T/b.tif", tiff(z, []))
        f.writestr("T/B.TFW", "0.5\n0\n0\n-0.5\n1.75\n1.75\n")
    grid_, meta = rs.merge_zips(spark, str(tmp_path))
    assert (meta.rows, meta.cols, meta.x0, meta.y0, meta.epsg) == (4, 7, 0.0, 2.0, 6676)
    got = {(r.r, r.c): r.z for r in grid_.collect()}
    assert got == {(r, c): float(z[r, c - 3]) if c >= 3 else 10.0 * (3 - r) + c for r in range(4) for c in range(7)}
    assert rs.zip_members(spark, f"{tmp_path}/a.zip", last=True).first().member == "x_dem.txt"
    assert rs.zip_members(spark, f"{tmp_path}/a.zip").first().member == "x_dem.txt"
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as f:
        f.writestr("x_dem.txt", xyz)
        f.writestr("z.txt", "0.25 0.25 7\n")
    assert rs.zip_members(spark, f"{tmp_path}/c.zip", last=True).first().member == "z.txt"
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as f:
        f.writestr("readme.md", "x")
    with pytest.raises(Exception, match="no TIF"):
        rs.read_zipped(spark, f"{tmp_path}/d.zip")[0].collect()


def test_rebase_with_other_cells(spark):
    cells = spark.createDataFrame([("coarse", 0, 0, 1.0), ("coarse", 0, 1, 2.0), *(("fine", r, c, 10.0 * r + c) for r in range(2) for c in range(2))], "path string, r int, c int, z double")
    catalogue = spark.createDataFrame([("coarse", 0.0, 4.0, 2.0, -2.0), ("fine", 4.0, 4.0, 1.0, -1.0)], "path string, x0 double, y0 double, px double, py double")
    got = {(r.path, r.r, r.c): r.z for r in rebase(cells, catalogue, GridMeta(2, 6, 1.0, 0.0, 4.0, 1.0, -1.0)).collect()}
    assert got == {("coarse", r, c): 1.0 + c // 2 for r in range(2) for c in range(4)} | {("fine", r, 4 + c): 10.0 * r + c for r in range(2) for c in range(2)}
    wide = rebase(cells.filter("path = 'fine'"), catalogue, GridMeta(1, 3, 2.0, 0.0, 4.0, 2.0, -2.0)).collect()
    assert [(r.r, r.c) for r in wide] == [(0, 2)]


def test_directory_scan(spark, tmp_path):
    place = lambda x: [(33550, "d", (1.0, 1.0, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x, 10.0, 0.0))]
    for name, x in (("a.tif", 0.0), ("b.TIF", 500.0)):
        (tmp_path / name).write_bytes(tiff(np.zeros((10, 10), "<f4"), place(x)))
    (tmp_path / "broken.tif").write_bytes(b"?")
    (tmp_path / "notes.txt").write_bytes(b"?")
    for folder in ("", "m1", "m2"):
        (tmp_path / folder).mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / folder / "z.zip", "w") as f:
            f.writestr("x", "y")
    name = lambda df: [(r.path.rsplit("/", 1)[1], r.kind) for r in df.collect()]
    assert name(rs.scan_directory(spark, str(tmp_path))) == [("a.tif", "tif"), ("b.TIF", "tif"), ("broken.tif", "tif"), ("z.zip", "zip")]
    assert name(rs.scan_directory(spark, str(tmp_path), (5.0, 5.0, 20.0, 20.0))) == [("a.tif", "tif"), ("broken.tif", "tif"), ("z.zip", "zip")]
    assert [(r.folder.rsplit("/", 1)[1], r.files) for r in rs.merge_folders(spark, str(tmp_path)).collect()] == [("m1", 1), ("m2", 1)]


def packed(data):
    """TIFF's LZW by its definition, with the table cleared before it is full."""
    bits, table, width, word = "", {}, 9, b""

    def put(code):
        nonlocal bits
        bits += format(code, f"0{width}b")

    put(256)
    table = {bytes([k]): k for k in range(256)} | {None: 256, False: 257}
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table)
        word = data[k : k + 1]
        width = max(9, (len(table)).bit_length())
        if len(table) >= 4094:
            put(table[word])
            width = min(12, len(table).bit_length())
            put(256)
            table, width, word = {bytes([k]): k for k in range(256)} | {None: 256, False: 257}, 9, b""
    if word:
        put(table[word])
    put(257)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaaa" * 50, b"abcabcabd" * 200, bytes(range(256)) * 3])
def test_lzw(data):
    assert rs.lzw(packed(data)) == data


def test_las_and_surface(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz = rng.integers(0, 2000, (500, 3)).astype("<i4")
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<H", head, 105, 20)
    struct.pack_into("<I", head, 107, 500)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 5.0, 6.0, 7.0)
    plain = bytes(head) + b"".join(p.tobytes() + bytes(8) for p in xyz)
    struct.pack_into("<H", head, 94, 227)
    plain = bytes(head) + plain[227:]
    stamped = rs.stamp_las(plain)
    assert len(stamped) == len(plain) + 54 + 24 and rs.stamp_las(stamped) == stamped
    (tmp_path / "a.las").write_bytes(stamped)
    cloud = rs.read_las(spark, f"{tmp_path}/a.las")
    pts = xyz * 0.01 + [5.0, 6.0, 7.0]
    meta = pt.surface_meta(cloud, 0.5)
    want = {}
    x0, y0 = pts[:, 0].min(), pts[:, 1].min()
    for x, y, z in pts:
        k = (meta.rows - 1 - int((y - y0) / 0.5), int((x - x0) / 0.5))
        want[k] = max(want.get(k, -1e9), np.float32(z))
    got = {(r.r, r.c): r.z for r in pt.highest(cloud, meta, y0).collect()}
    assert got == pytest.approx(want)


def test_xyz(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n0.25 0.25 1\n0.75 0.25 2\nbroken\n0.25 0.75 3\n1 2\n0.25 0.25 9\n")
    (tmp_path / "b.txt").write_text("1,0.25,0.25,5,1\n2,0.75,0.75,x\n3,0.75,0.75,6\n")
    points = pt.parse_xyz(rs.read_lines(spark, f"{tmp_path}/*.txt"))
    one = points.filter(F.col("file").endswith("a.txt"))
    meta = pt.xyz_meta(one)
    assert (meta.rows, meta.cols, meta.x0, meta.y0) == (2, 2, 0.0, 1.0)
    assert {(r.r, r.c): r.z for r in pt.latest(one, meta).collect()} == {(1, 0): 9.0, (1, 1): 2.0, (0, 0): 3.0}
    assert sorted(r.z for r in points.filter(F.col("file").endswith("b.txt")).collect()) == [5.0, 6.0]


def test_png_tiles(spark, tmp_path):
    rgb = np.random.default_rng(3).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    lines = []
    for r in range(6):
        kind, line, up = r % 5, rgb[r].astype(int), rgb[r - 1].astype(int) if r else np.zeros((5, 3), int)
        left, corner = np.vstack([np.zeros((1, 3), int), line[:-1]]), np.vstack([np.zeros((1, 3), int), up[:-1]])
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
        lines.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert np.array_equal(rs.png_pixels(data), rgb)
    (tmp_path / "15" / "7").mkdir(parents=True)
    (tmp_path / "15" / "7" / "9.png").write_bytes(data)
    rows = rs.read_tiles(spark, f"{tmp_path}/15/*/*.png").collect()
    assert len(rows) == 30 and all((r.tx, r.ty) == (7, 9) and (r.R, r.G, r.B) == tuple(rgb[r.py, r.px]) for r in rows)
    assert io.BytesIO(data).read(4)


def test_tile_codes(spark):
    code = F.col("code")
    df = spark.createDataFrame([("08LB0000",), ("08PF9999",), ("08MD4437",)], "code string")
    box = tf.code_extent(code)
    ext = df.select(code.alias("ext_id"), *[b.cast("double").alias(n) for b, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    found = tiles.tiles_for_extents(ext).collect()
    assert {(r.ext_id, r.code) for r in found} == {(c, c) for (c,) in df.collect()}  # touching tiles don't count
    with pytest.raises(MemoryError):
        tiles.tile_pixels(spark.createDataFrame([], "tx long, ty long, px int, py int, z double"), 0, 0, 100, 100)
    assert cell_metres(0.001, geographic=True, latitude=0.0) == pytest.approx(111.32)


def test_run_names(spark):
    df = spark.createDataFrame([("0019",), ("0010+0",), ("0010+2",), ("001",), ("00101",), ("0021",)], "name string")
    assert [(r.name, r.seq, r.files) for r in runs.sorted_runs(df).collect()] == [("0019", 1, 9), ("0010+0", 1, 10), ("0010+2", 1, 12), ("0021", 2, 1)]
    assert runs.next_sequence(df).first().seq == "003" and runs.next_sequence(df, overwrite=True).first().seq == "002"
    assert runs.next_sequence(df.limit(0)).first().seq == "001"
    assert runs.next_sequence(spark.createDataFrame([("9993",)], "name string")).first().seq == "1000"
    text = spark.createDataFrame([(None,), ("{}",), ("oops",), ('{"analyses": ["valley"], "twi_thresh": 8}',)], "j string").select(runs.condition_text("j").alias("t")).collect()
    assert [r.t for r in text] == ["No condition data (legacy run)", "No conditions", "Error reading condition file", "Valley: TWI≥8.0 · min area - m²"]


def test_ramps(spark):
    shade = style.ramp(F.col("v"), style.FIXED["integrated_risk_index"])
    rows = spark.createDataFrame([(-1.0,), (1.0,), (3.0,), (9.0,), (None,)], "v double").select(shade.alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in rows] == [(60, 180, 60, 255), (157, 200, 30, 255), (255, 130, 0, 255), (200, 0, 0, 255), None]


def test_stored_runs(spark, tmp_path, monkeypatch):
    z = np.random.default_rng(4).normal(size=(9, 8)).cumsum(1)
    meta = GridMeta(9, 8, 2.0, 0.0, 18.0, 2.0, -2.0)
    cells = analyse(grid(spark, z), meta)
    out = str(tmp_path)
    name = store.save_run(cells, meta, AnalysisParams(), out)
    assert name == "0016" and store.run_names(spark, out) == ["0016"]  # slope and shc aren't counted
    stored, manifest = store.load_run(spark, out)
    assert manifest["analyses"] == ["stability", "valley"] and "slope" in stored.columns
    risk = {(r.r, r.c): r.risk for r in store.integrate(stored).collect()}
    assert risk == {(r.r, r.c): r.integrated_risk_index for r in cells.collect()}
    assert store.save_run(cells, meta, AnalysisParams(), out) == "0026"
    assert store.save_run(cells, meta, AnalysisParams(), out, overwrite=True) == "0026" and len(store.run_names(spark, out)) == 2
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    assert [p.name[:5] for p in (tmp_path / "0026").iterdir() if p.is_dir()] == ["data-"]  # the old data went
    monkeypatch.setattr(store.runs, "run_name", lambda seq, files: F.lit("0016"))  # a name that is taken: the new run can't be placed
    with pytest.raises(OSError):
        store.save_run(cells, meta, AnalysisParams(), out, overwrite=True)
    assert store.run_names(spark, out) == ["0016", "0026"] and store.load_run(spark, out)[0].count() == 72
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    assert store.latest_path(spark, out, ["00*", "nothing*"]).endswith("/0026") and store.latest_path(spark, out, ["x*"]) is None
    assert store.prefixed_path(spark, out, "002", "6", "").endswith("/0026") and store.prefixed_path(spark, out, "9", "6", "") is None
    assert store.output_path("o", "twi", ".tif", True) == "o/twi.tif" and store.output_path("o", "twi", ".tif", False, datetime(2024, 1, 31, 23, 59, 58)) == "o/twi_20240131_235958.tif"
    store.main([out, "--multiplicative"])
    assert spark.read.parquet(f"{out}/integrated_risk").count() == 72
    names = spark.createDataFrame([("b.las", "../b.las"), ("a.las", "../a.las")], "filename string, relative string")
    assert store.las_manifest(names).first().value == '{"las":[{"filename":"a.las","relative":"../a.las"},{"filename":"b.las","relative":"../b.las"}]}'


def test_two_writers_at_once(spark, tmp_path):
    """Both take the number of their own, and both runs are whole; what a lost writer left is recovered."""
    z = np.random.default_rng(4).normal(size=(9, 8)).cumsum(1)
    meta, out = GridMeta(9, 8, 2.0, 0.0, 18.0, 2.0, -2.0), str(tmp_path)
    cells = analyse(grid(spark, z), meta)
    with ThreadPoolExecutor(2) as pool:
        names = sorted(pool.map(lambda _: store.save_run(cells, meta, AnalysisParams(), out), range(2)))
    assert names == ["0016", "0026"] == store.run_names(spark, out)
    for name in names:
        assert store.load_run(spark, out, name)[0].count() == 72
    # A driver that was lost: a claim, data without a manifest, and data beside a manifest's.
    (tmp_path / ".claim_003").touch()
    for place in ("0036/data-lost", "0026/data-lost"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "x").touch()
    assert store.save_run(cells, meta, AnalysisParams(), out) == "0046"  # the claimed number is left alone
    with pytest.raises(FileExistsError):
        (tmp_path / ".claim_004").touch()
        store.save_run(cells, meta, AnalysisParams(), out, overwrite=True)
    assert store.recover(spark, out) == [] and (tmp_path / "0036").exists()  # too young
    assert store.recover(spark, out, hours=-1) == ["003", "004"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0016", "0026", "0046"] and store.load_run(spark, out, "0026")[0].count() == 72


def test_one_geotiff(spark, tmp_path):
    z = np.random.default_rng(5).normal(size=(75, 53)).astype("f4").astype(float)
    z[3, 4], z[5, 6], z[40:, 20:] = np.nan, np.inf, np.nan
    meta = GridMeta(75, 53, 0.5, 100.0, 900.0, 0.5, -0.5, 6676)
    rows = spark.createDataFrame([(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z) if r < 48 or c < 32], "r int, c int, v double")
    for name, classic in (("classic", 4 << 30), ("large", 2000)):
        path = f"{tmp_path}/{name}.tif"
        size = onefile.write_one_geotiff(rows, meta, path, "v", tile=16, classic=classic, stretch=7)
        data = (tmp_path / f"{name}.tif").read_bytes()
        assert len(data) == size and struct.unpack_from("<H", data, 2)[0] == (42 if name == "classic" else 43)
        assert np.array_equal(rs.tiff_pixels(data), z, equal_nan=True) and rs.tiff_meta(data) == (meta, -9999.0)
        got = {(r.r, r.c): r.z for r in rs.read_geotiff(spark, path).collect()}
        assert len(got) == z.size and all((v is None and np.isnan(z[k])) or v == z[k] for k, v in got.items())
        assert rs.tiff_layout(data)[2].count(0) == 4  # tiles without a cell
    onefile.write_one_geotiff(rows, meta, f"{tmp_path}/one.tif", "v", tile=80)
    assert np.array_equal(rs.tiff_pixels((tmp_path / "one.tif").read_bytes()), z, equal_nan=True)
    with pytest.raises(OSError):
        files.join_files(f"{tmp_path}/broken.tif", [b"head", f"{tmp_path}/missing.part"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["classic.tif", "large.tif", "one.tif"]


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_checksums(a, b):
    assert bundle.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("long", [0xFFFFFFFF, 3000])
def test_export_bundle(spark, tmp_path, long):
    """Python's own reader takes a bundle of stretches, short and long."""
    rng = np.random.default_rng(7)
    made = {"dem/dtm.tif": rng.integers(0, 9, 10_000).astype("u1").tobytes(), "dem/größe.bin": rng.bytes(4096), "empty": b"", "one": b"x"}
    paths = {}
    for k, (name, data) in enumerate(made.items()):
        (tmp_path / f"{k}.dat").write_bytes(data)
        paths[name] = f"file://{tmp_path}/{k}.dat" if k % 2 else f"{tmp_path}/{k}.dat"
    folder = tmp_path / "zip"
    for name in ("x_20240131-all.zip", "x_20240131_2-all.zip", "x_20240131_3-all.zip"):
        assert bundle.counted_name(str(folder), "x", datetime(2024, 1, 31)) == name
        path = f"{folder}/{name}"
        size = bundle.export_bundle(spark, path, paths, {"las_sources.json": "{}", "README.txt": "ü" * 4000}, stretch=1024, long=long)
        assert (folder / name).stat().st_size == size
        with zipfile.ZipFile(path) as f:
            assert f.testzip() is None
            assert {n: f.read(n) for n in f.namelist()} == made | {"las_sources.json": b"{}", "README.txt": ("ü" * 4000).encode()}
    with pytest.raises(FileNotFoundError):
        bundle.export_bundle(spark, f"{folder}/y.zip", {"a": f"{tmp_path}/missing"})
    assert bundle.export_bundle(spark, f"{folder}/z.zip", {}) == 22 and zipfile.ZipFile(folder / "z.zip").namelist() == []
    assert sorted(p.name for p in folder.iterdir()) == ["x_20240131-all.zip", "x_20240131_2-all.zip", "x_20240131_3-all.zip", "z.zip"]


def test_stored_cells(spark, tmp_path):
    z = np.random.default_rng(6).normal(size=(60, 70))
    meta, path = GridMeta(60, 70, 1.0, 100.0, 500.0, 1.0, -1.0), f"{tmp_path}/cells"
    store_cells.write_cells(grid(spark, z), meta, path, tile=16)
    assert len(list((tmp_path / "cells").glob("tile=*"))) == 20
    whole = store_cells.read_cells(spark, path)
    assert {(r.r, r.c): r.z for r in whole.collect()} == {k: v for k, v in np.ndenumerate(z)}
    cut, part = store_cells.read_window(spark, path, meta, 117.0, 470.0, 131.0, 482.5, tile=16)
    assert {(r.r, r.c): r.z for r in cut.collect()} == {(r, c): z[r + 17, c + 17] for r in range(part.rows) for c in range(part.cols)} and part.rows == 13
    assert {int(re.search(r"tile=(\d+)", f)[1]) for f in cut.inputFiles()} == set(range(20))  # listed
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tile" in plan.split("PartitionFilters: [")[1].split("]")[0]
    points = spark.createDataFrame([(k, 100.0 + k % 75 - 2.0, 500.0 - k % 13 + 1.0) for k in range(90)], "k int, x double, y double")
    want = {r.k: r.z for r in rasters.sample_points(points, whole, meta).collect()}
    assert {r.k: r.z for r in store_cells.sample_stored(points, path, meta, tile=16).collect()} == want and any(v is not None for v in want.values())
    # Few points: cells aren't dealt out. Many: they are.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for few, exchanged in ((10**5, False), (10, True)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(rasters, "FEW", few)
            m.setattr(store_cells, "FEW", few)
            for got in (rasters.sample_points(points, whole, meta), store_cells.sample_stored(points, path, meta, tile=16)):
                assert {r.k: r.z for r in got.collect()} == want
                scans = [p for p in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(r" in p]
                assert bool(scans) == exchanged or not exchanged
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert store_cells.sample_stored(points.limit(0), path, meta, tile=16).count() == 0


def test_stream_of_points(spark, tmp_path):
    meta, landed = GridMeta(4, 4, 1.0), str(tmp_path / "in")
    for k, z in enumerate((5.0, 9.0, 7.0)):
        spark.createDataFrame([(0.5, 0.5, z), (3.5, 1.5, float(k))], "x double, y double, z float").write.mode("append").parquet(landed)
        landing.keep_surface(landing.point_stream(spark, landed), meta, 0.0, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.r, r.c): r.z for r in landing.surface(spark, str(tmp_path / "out")).collect()} == {(3, 0): 9.0, (2, 3): 2.0}
