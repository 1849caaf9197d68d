"""Sources that read files by blocks: what is read, by how many tasks, and that it is right."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from ridgeline.grid import GridMeta
from ridgeline.operators.rasters import clip
from ridgeline.sources import blocks
from ridgeline.sources import raster as rs


def tiled(z, tile, packing=8, big=True):
    """A large TIFF of float32 tiles."""
    rows, cols = z.shape
    full = np.full((-(-rows // tile) * tile, -(-cols // tile) * tile), -9999.0, "<f4")
    full[:rows, :cols] = np.where(np.isnan(z), -9999.0, z)
    bodies = [full[r : r + tile, c : c + tile].tobytes() for r in range(0, full.shape[0], tile) for c in range(0, full.shape[1], tile)]
    bodies = [zlib.compress(b) if packing == 8 else b for b in bodies]
    places = (16 + np.cumsum([0, *map(len, bodies)])).tolist()
    at = places.pop()
    tags = [(256, "I", (cols,)), (257, "I", (rows,)), (258, "H", (32,)), (259, "H", (packing,)), (277, "H", (1,)), (322, "I", (tile,)), (323, "I", (tile,)), (324, "Q", tuple(places)), (325, "Q", tuple(map(len, bodies))), (339, "H", (3,)), (42113, "s", (b"-9999\0",))]
    extra, entries, start = b"", b"", at + 8 + 20 * len(tags) + 8
    for tag, kind, values in tags:
        data = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        field = data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", start + len(extra))
        extra += data if len(data) > 8 else b""
        entries += struct.pack("<HHQ", tag, {"H": 3, "I": 4, "Q": 16, "s": 2}[kind], len(data) if kind == "s" else len(values)) + field
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) + b"".join(bodies) + struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0) + extra


@pytest.fixture
def counted(monkeypatch):
    """Bytes read through open_at in this process."""
    seen, plain = [0], blocks.open_at

    def opened(path):
        file = plain(path)
        read = file.read_at
        file.read_at = lambda size, at: (seen.__setitem__(0, seen[0] + size), read(size, at))[1]
        return file

    monkeypatch.setattr(blocks, "open_at", opened)
    return seen


def test_a_window_opens_its_blocks_alone(spark, tmp_path, counted):
    z = np.random.default_rng(1).normal(size=(300, 410)).astype("<f4").astype(float)
    z[7, 9] = np.nan
    path = f"{tmp_path}/a.tif"
    (tmp_path / "a.tif").write_bytes(data := tiled(z, 32))
    reader = blocks.TiffBlocks({"paths": json.dumps([path]), "cells": "4096"}).reader(None)
    filters = [GreaterThanOrEqual(("r",), 40), LessThan(("r",), 70), EqualTo(("c",), 100), EqualTo(("path",), path)]
    assert list(reader.pushFilters(filters)) == filters
    parts = reader.partitions()
    assert [k for p in parts for k, _, _ in p.blocks] == [1 * 13 + 3, 2 * 13 + 3]
    got = {(r, c): v for p in parts for b in reader.read(p) for r, c, v in zip(*(b.column(k).to_pylist() for k in ("r", "c", "z")), strict=True)}
    assert got == {(r, c): z[r, c] for r in range(32, 96) for c in range(96, 128)}
    assert counted[0] < len(data) / 20
    whole = blocks.TiffBlocks({"paths": json.dumps([path]), "cells": "4096"}).reader(None).partitions()
    assert len(whole) == 33 and sum(len(p.blocks) for p in whole) == 130
    # The same through Spark.
    cut, part = clip(rs.read_geotiff(spark, path), GridMeta(300, 410, 1.0, 0.0, 300.0, 1.0, -1.0), 100.5, 230.5, 131.5, 260.5)
    got = {(r.r, r.c): r.z for r in cut.collect()}
    assert got == {(r, c): z[r + 39, c + 100] for r in range(part.rows) for c in range(part.cols)} and len(got) > 900
    assert rs.read_geotiff(spark, path).filter("r = 7 AND c = 9").first().z is None
    assert cut.rdd.getNumPartitions() == 1


def test_a_file_above_two_gigabytes(spark, tmp_path):
    """Raw strips, mostly holes on disk: many partitions, and a window of it."""
    rows, cols = 40_000, 20_000
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)
    n, size = rows // 100, 100 * cols * 4
    tags = [(256, 4, 1, cols), (257, 4, 1, rows), (258, 3, 1, 32), (259, 3, 1, 1), (273, 16, n, 1000), (277, 3, 1, 1), (278, 4, 1, 100), (279, 16, n, 1000 + 8 * n), (339, 3, 1, 3)]
    table = struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0)
    body = 1000 + 16 * n
    with open(tmp_path / "big.tif", "wb") as f:
        f.write((head + table).ljust(1000, b"\0") + np.arange(n, dtype="<u8").__mul__(size).__add__(body).tobytes() + np.full(n, size, "<u8").tobytes())
        f.seek(body + (35_000 * cols + 12_345) * 4)
        f.write(struct.pack("<3f", 1.5, 2.5, 3.5))
        f.truncate(body + rows * cols * 4)
    assert (tmp_path / "big.tif").stat().st_size > 2 << 30
    cells = rs.read_geotiff(spark, f"{tmp_path}/big.tif")
    assert cells.rdd.getNumPartitions() == 200
    window = cells.filter("r >= 34999 AND r <= 35000 AND c BETWEEN 12344 AND 12348")
    assert window.rdd.getNumPartitions() == 1
    assert sorted((r.r, r.c, r.z) for r in window.collect() if r.z) == [(35000, 12345, 1.5), (35000, 12346, 2.5), (35000, 12347, 3.5)]


def test_points_by_ranges(spark, tmp_path):
    n = 150_000
    xyz = np.random.default_rng(3).integers(-(10**6), 10**6, (n, 3)).astype("<i4")
    head = bytearray(375)
    head[:4] = b"LASF"
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<HI", head, 105, 20, n)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.001, 1000.0, 2000.0, 5.0)
    (tmp_path / "a.las").write_bytes(bytes(head) + np.concatenate([xyz.view(np.uint8).reshape(n, 12), np.zeros((n, 8), np.uint8)], axis=1).tobytes())
    reader = blocks.LasBlocks({"paths": json.dumps([f"{tmp_path}/a.las"]), "cells": str(1 << 16)}).reader(None)
    assert len(reader.partitions()) == 3
    got = rs.read_las(spark, f"{tmp_path}/a.las").toPandas()
    assert np.allclose(got[["x", "y"]].to_numpy(), xyz[:, :2] * 0.01 + [1000.0, 2000.0]) and np.allclose(got["z"], xyz[:, 2] * 0.001 + 5.0, atol=1e-3)
    (tmp_path / "b.las").write_bytes(b"nonsense")
    with pytest.raises(ValueError):
        blocks.LasBlocks({"paths": json.dumps([f"{tmp_path}/b.las"])}).reader(None).partitions()


def test_empty_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    assert blocks.TiffBlocks({"paths": "[]"}).reader(None).partitions() == []
