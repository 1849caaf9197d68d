"""One GeoTIFF of a whole grid: tasks pack its tiles, and one commit joins what they wrote.

Each task writes the tiles it has into a part file; the parts' sizes, summed up in order,
say where every tile will lie. The tables of places and sizes are written by tasks as well,
a stretch of tiles each. The commit copies header, tables and parts into one file, which
appears under its name when it is whole. Files beyond 4 GB get the large format.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta
from ridgeline.sources.files import join_files, remove, save
from ridgeline.sources.raster import NODATA
from ridgeline.storage import materialise, scratch

#: Cells along a tile's edge, tiles of a stretch of the tables, and bytes that the classic format can hold.
TILE, STRETCH, CLASSIC = 512, 1 << 20, (4 << 30) - 1


def _packed(meta: GridMeta, tile: int):
    across = -(-meta.cols // tile)

    def pack(table: pa.Table) -> pa.Table:
        t = table.column("t")[0].as_py()
        cells = np.full((tile, tile), NODATA, "<f4")
        z = table.column("z").to_numpy()
        cells[table.column("r").to_numpy() - t // across * tile, table.column("c").to_numpy() - t % across * tile] = np.where(np.isnan(z), NODATA, z)
        return pa.table({"t": pa.array([t], pa.int64()), "body": pa.array([zlib.compress(cells.tobytes())], pa.binary())})

    return pack


def _parts(folder: str):
    """Writes the tiles of a task one after another; tells the part, and each tile's place and size in it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, rows, name = [], [], None
        context = TaskContext.get()
        stem, n, at = f"{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex[:12]}", 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            path = save(folder, f"{stem}-{n:04d}.part", b"".join(body))
            t, place, size = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(t, pa.int64()), pa.array(place, pa.int64()), pa.array(size, pa.int64())], ["part", "t", "place", "size"])

        for batch in batches:
            for t, data in zip(batch.column("t").to_pylist(), batch.column("body").to_pylist(), strict=True):
                rows.append((t, at, len(data)))
                body.append(data)
                at += len(data)
                if at >= 64 << 20:
                    yield from flush()
                    body, rows, n, at = [], [], n + 1, 0
        if rows:
            yield from flush()

    return write


def _stretch(folder: str, stretch: int, tiles: int, kind: str):
    """Writes the places and the sizes of a stretch of tiles as two part files; absent tiles are zeros."""

    def write(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        first = k * stretch
        arrays = np.zeros((2, min(stretch, tiles - first)), kind)
        given = table.filter(pc.is_valid(table.column("t")))
        for i, c in enumerate(("place", "size")):
            arrays[i, given.column("t").to_numpy() - first] = given.column(c).to_numpy()
        paths = [save(folder, f"{c}-{k:08d}-{uuid.uuid4().hex[:12]}.part", arrays[i].tobytes()) for i, c in enumerate(("place", "size"))]
        return pa.table({"k": pa.array([k], pa.int64()), "places": [paths[0]], "sizes": [paths[1]]})

    return write


def _head(meta: GridMeta, tile: int, tiles: int, big: bool) -> tuple[bytes, list[int]]:
    """Header and tags up to the tables, and where the two tables start."""
    word = "Q" if big else "I"
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, meta.epsg or 3857)
    tags = [
        (256, "I", (meta.cols,)), (257, "I", (meta.rows,)), (258, "H", (32,)), (259, "H", (8,)), (262, "H", (1,)), (277, "H", (1,)), (322, "I", (tile,)), (323, "I", (tile,)), (324, word, None), (325, word, None), (339, "H", (3,)),
        (33550, "d", (abs(meta.px), abs(meta.py), 0.0)), (33922, "d", (0.0, 0.0, 0.0, meta.x0, meta.y0, 0.0)), (34735, "H", keys), (42113, "s", f"{NODATA:g}".encode() + b"\0"),
    ]
    start, wide, entry = (16, 8, 20) if big else (8, 4, 12)
    extra_at = start + (8 if big else 2) + entry * len(tags) + wide
    sized = [struct.pack(f"<{len(v)}{k}", *v) if k != "s" and v is not None else v for _, k, v in tags]
    tables_at = extra_at + sum(len(d) + len(d) % 8 for d in sized if d is not None and len(d) > wide)
    tables_at += -tables_at % 8
    tables = [tables_at, tables_at + tiles * wide]
    extra, entries, codes = b"", b"", {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    for (tag, kind, values), data in zip(tags, sized, strict=True):
        count = tiles if data is None else len(data) if kind == "s" else len(values)
        if data is None:
            field = struct.pack("<" + word, tables[tag - 324])
        elif len(data) > wide:
            field = struct.pack("<" + word, extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 8)
        else:
            field = data.ljust(wide, b"\0")
        entries += struct.pack("<HHQ" if big else "<HHI", tag, codes[kind], count) + field
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start)
    count = struct.pack("<Q" if big else "<H", len(tags))
    return (head + count + entries + b"\0" * wide + extra).ljust(tables_at, b"\0"), tables


def write_one_geotiff(grid: DataFrame, meta: GridMeta, path: str, value: str = "z", tile: int = TILE, classic: int = CLASSIC, stretch: int = STRETCH) -> int:
    """Writes a grid as one tiled, deflated float32 GeoTIFF; returns its bytes.

    NaN and nulls become nodata, infinity stays; tiles without a row are left out, which
    readers take for nodata. A grid without a CRS is stamped as Web Mercator. ``tile`` is a
    multiple of 16. The driver holds a line for each part of 64 MB and copies the parts.
    """
    spark = grid.sparkSession
    across, down = -(-meta.cols // tile), -(-meta.rows // tile)
    tiles, folder = across * down, scratch(spark, "tiff-parts")
    number = (F.floor(F.col("r") / tile) * across + F.floor(F.col("c") / tile)).cast("long")
    cells = grid.select(number.alias("t"), "r", "c", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("z"))
    packed = cells.groupBy("t").applyInArrow(_packed(meta, tile), "t long, body binary")
    written = materialise(packed.mapInArrow(_parts(folder), "part string, t long, place long, size long"), "tiff-tiles")
    parts = [(r.part, r.size) for r in written.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").toLocalIterator()]
    body = sum(size for _, size in parts)
    big = len(_head(meta, tile, tiles, False)[0]) + 8 * tiles + body > classic
    wide = 8 if big else 4
    head, tables = _head(meta, tile, tiles, big)
    at, bases = tables[1] + tiles * wide, []
    for part, size in parts:
        bases.append((part, at))
        at += size
    base = spark.createDataFrame(bases, "part string, base long")
    placed = written.join(F.broadcast(base), "part").select("t", (F.col("place") + F.col("base")).alias("place"), "size")  # a row for 64 MB of the file
    stretches = spark.range(-(-tiles // stretch)).select(F.col("id").alias("k"))
    rows = stretches.join(placed.withColumn("k", F.floor(F.col("t") / stretch)), "k", "left")
    lists = sorted(materialise(rows.groupBy("k").applyInArrow(_stretch(folder, stretch, tiles, "<u8" if big else "<u4"), "k long, places string, sizes string"), "tiff-tables").collect())
    pieces = [head, *(r.places for r in lists), *(r.sizes for r in lists)]
    if tiles == 1:  # a table of one number stands in the tag itself
        pieces = [_inline(head, placed.first(), big)]
        pieces.append(b"\0" * (2 * wide))
    size = join_files(path, [*pieces, *(part for part, _ in parts)])
    remove(folder)
    return size


def _inline(head: bytes, row, big: bool) -> bytes:
    start, entry, word = (24, 20, "<Q") if big else (10, 12, "<I")
    out = bytearray(head)
    for k, v in ((8, row.place if row else 0), (9, row.size if row else 0)):
        struct.pack_into(word, out, start + entry * k + entry - (8 if big else 4), v)
    return bytes(out)
