"""Raster files as cells and back: GeoTIFF, XYZ text, LAS points, zipped members, PNG tiles.

Files come through Spark's ``binaryFile`` source, one row a file, and are parsed by the
tasks that read them. A file is the unit: inputs are survey tiles of bounded size.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.grid import GridMeta, cell_metres
from ridgeline.operators import points as pt
from ridgeline.operators.rasters import merge, overlaps
from ridgeline.sources import blocks
from ridgeline.sources.files import open_at, save

NODATA = -9999.0
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 13: "I", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


class Bytes:
    """A file in memory, read like one that is opened for random access."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, size: int, offset: int) -> bytes:
        return bytes(self.data[offset : offset + size])


def tiff_tags(file) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image; classic and large TIFF. Reads the header's parts alone."""
    file = Bytes(file) if isinstance(file, (bytes, bytearray, memoryview)) else file
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF")
    (magic,) = struct.unpack_from(order + "H", head, 2)
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)
    counted, entry, field = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
    wide, inline = struct.calcsize("<" + counted), 8 if big else 4
    (n,) = struct.unpack(order + counted, file.read_at(wide, at))
    step = struct.calcsize("<" + entry) + inline
    table = file.read_at(step * n, at + wide)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + entry, table, step * k)
        if kind not in _TYPES:
            continue
        form = order + (f"{count}s" if kind == 2 else str(count * len(_TYPES[kind])) + _TYPES[kind][0])
        size, place = struct.calcsize(form), step * (k + 1) - inline
        data = table[place : place + size]
        if size > inline:
            (place,) = struct.unpack_from(order + field, table, place)
            data = file.read_at(size, place)
        tags[tag] = struct.unpack(form, data)
    return order, tags


def tiff_meta(file, world: str | None = None) -> tuple[GridMeta, float | None]:
    """Georeference and nodata value, without a pixel. ``world`` is a world file's text, for files without a georeference.

    The cell is in metres: of a grid in degrees it is the pixel's width at the central latitude.
    """
    _, tags = tiff_tags(file)
    keys = tags.get(34735, ())
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    epsg = next((named[k] for k in (3072, 2048) if k in named), 0)
    rows, cols = tags[257][0], tags[256][0]
    sx, sy = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0.0,) * 6)
    x0, y0, px, py = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, -sy
    if 34264 in tags:
        px, x0, py, y0 = (tags[34264][k] for k in (0, 3, 5, 7))
    elif 33550 not in tags and world is not None:
        px, _, _, py, x0, y0 = (float(v) for v in world.split()[:6])
        x0, y0 = x0 - px / 2, y0 - py / 2  # a world file gives the centre of the first pixel
    # A model type of 2, or a geographic key without a projected one, is a grid in degrees.
    degrees = named.get(1024) == 2 or (2048 in named and 3072 not in named and 1024 not in named)
    cell = cell_metres(px, geographic=degrees, latitude=y0 + py * rows / 2)
    nodata = float(tags[42113][0].rstrip(b"\0 ")) if 42113 in tags else None
    return GridMeta(rows, cols, cell, x0, y0, px, py, int(epsg)), nodata


def lzw(data: bytes) -> bytes:
    """Unpacks a strip in TIFF's variable-length code: 256 clears the table, 257 ends.

    The width of a code hangs on its number since the last clearing alone (it grows one
    code early), so the codes up to the next clearing are cut out at once. A code above
    257 stands for an earlier word and the byte after it, which are next to each other
    in what is unpacked.
    """
    octets = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    widths = np.minimum(12, np.floor(np.log2(np.arange(4096) + 258)).astype(np.int64) + 1)
    offsets = np.concatenate([[0], np.cumsum(widths)])
    out, bit, total = bytearray(), 0, 8 * len(data)
    while bit + 9 <= total:
        many = int(np.searchsorted(offsets, total - bit, "right")) - 1
        at = bit + offsets[:many]
        word = octets[at >> 3] << np.uint32(16) | octets[(at >> 3) + 1] << np.uint32(8) | octets[(at >> 3) + 2]
        codes = (word >> (24 - (at & 7) - widths[:many]).astype(np.uint32)) & ((1 << widths[:many]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        used = int(stop[0]) if len(stop) else many
        starts, sizes = [], []
        for code in codes[:used].tolist():
            here = len(out)
            if code < 256:
                out.append(code)
            else:
                first, size = starts[code - 258], sizes[code - 258] + 1
                out += out[first : first + size]
                if len(out) - here < size:  # the word that this very code completes
                    out.append(out[first])
            starts.append(here)
            sizes.append(len(out) - here)
        if not len(stop) or codes[used] == 257:
            break
        bit += int(offsets[used + 1])
    return bytes(out)


def undo_predictor(part: np.ndarray, kind: np.dtype, predictor: int) -> np.ndarray:
    """Rows x columns x bands as they were before differences were taken along rows (2), or of bytes by significance (3)."""
    if predictor == 2:
        return np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("=")).astype(kind)
    rows, cols, bands = part.shape
    planes = np.cumsum(part.view(np.uint8).reshape(rows, -1, bands), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * bands)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, bands)


@dataclass(frozen=True)
class Layout:
    """How a TIFF's cells lie in its blocks (strips or tiles)."""

    rows: int
    cols: int
    height: int
    width: int
    bands: int
    kind: str
    packing: int
    predictor: int
    nodata: float | None

    def window(self, k: int) -> tuple[int, int, int, int]:
        """First row and column of block ``k``, and how many of its rows and columns the image has."""
        across = -(-self.cols // self.width)
        r0, c0 = k // across * self.height, k % across * self.width
        return r0, c0, min(self.height, self.rows - r0), min(self.width, self.cols - c0)

    def cells(self, k: int, raw: bytes) -> np.ndarray:
        """Band 1 of block ``k`` as doubles, nodata as NaN; a block without bytes has no data."""
        _, _, h, w = self.window(k)
        if not raw:
            return np.full((h, w), np.nan)
        unpack = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress}[self.packing]
        kind = np.dtype(self.kind)
        part = np.frombuffer(unpack(raw), kind).reshape(-1, self.width, self.bands)
        part = (part if self.predictor == 1 else undo_predictor(part, kind, self.predictor))[:h, :w, 0].astype(float)
        return part if self.nodata is None else np.where(part == self.nodata, np.nan, part)


def tiff_layout(file) -> tuple[Layout, tuple[int, ...], tuple[int, ...]]:
    """The layout, and where each block lies: offsets and sizes. Reads the header's parts alone."""
    order, tags = tiff_tags(file)
    packing, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if packing not in (1, 5, 8, 32946) or predictor not in (1, 2, 3):
        raise ValueError("only raw, deflated and LZW TIFF is read")
    rows, cols = tags[257][0], tags[256][0]
    height, width = (tags[323][0], tags[322][0]) if 324 in tags else (min(rows, tags.get(278, (rows,))[0]), cols)
    places, sizes = (tags[324], tags[325]) if 324 in tags else (tags[273], tags[279])
    nodata = float(tags[42113][0].rstrip(b"\0 ")) if 42113 in tags else None
    kind = f"{order}{_KINDS[tags.get(339, (1,))[0]]}{tags[258][0] // 8}"
    n = -(-rows // height) * -(-cols // width)  # of the first band, where bands lie apart
    return Layout(rows, cols, height, width, tags.get(277, (1,))[0] if tags.get(284, (1,))[0] == 1 else 1, kind, packing, predictor, nodata), places[:n], sizes[:n]


def tiff_pixels(data: bytes) -> np.ndarray:
    """Band 1 as doubles, nodata as NaN; strips or tiles, raw, deflated or LZW, with or without a predictor."""
    layout, places, sizes = tiff_layout(data)
    out = np.full((layout.rows, layout.cols), np.nan)
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        r0, c0, h, w = layout.window(k)
        out[r0 : r0 + h, c0 : c0 + w] = layout.cells(k, data[at : at + size])
    return out


def tiff_bytes(pixels: np.ndarray, meta: GridMeta) -> bytes:
    """A deflated float32 GeoTIFF of one strip; NaN becomes nodata, infinity stays."""
    body = zlib.compress(np.where(np.isnan(pixels), NODATA, pixels).astype("<f4").tobytes())
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, meta.epsg)
    tags = [
        (256, "I", (pixels.shape[1],)), (257, "I", (pixels.shape[0],)), (258, "H", (32,)), (259, "H", (8,)), (262, "H", (1,)), (273, "I", (8,)), (277, "H", (1,)), (278, "I", (pixels.shape[0],)), (279, "I", (len(body),)), (339, "H", (3,)),
        (33550, "d", (abs(meta.px), abs(meta.py), 0.0)), (33922, "d", (0.0, 0.0, 0.0, meta.x0, meta.y0, 0.0)), (34735, "H", keys), (42113, "s", (f"{NODATA:g}".encode() + b"\0",)),
    ]
    at = 8 + len(body) + len(body) % 2
    extra, entries = b"", b""
    start = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        packed = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        count = len(packed) if kind == "s" else len(values)
        code = {"H": 3, "I": 4, "d": 12, "s": 2}[kind]
        if len(packed) > 4:
            field = struct.pack("<I", start + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            field = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, code, count) + field
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def _cells(path: str, pixels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Row strips of about 64k cells."""
    step = max(1, 65_536 // max(1, pixels.shape[1]))
    for r0 in range(0, pixels.shape[0], step):
        z = pixels[r0 : r0 + step]
        r, c = np.indices(z.shape, dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"path": pa.array([path] * z.size), "r": pa.array((r + r0).ravel()), "c": pa.array(c.ravel()), "z": pa.array(z.ravel(), mask=np.isnan(z).ravel())})


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """All cells of all files under a path or pattern: path, r, c, z.

    Tasks read blocks by range, whatever a file's size, and predicates on r and c leave the
    blocks out that they rule out (``blocks.TiffBlocks``).
    """
    return blocks.load(spark, blocks.TiffBlocks, path)


CATALOG = "path string, rows int, cols int, cell double, epsg int, x0 double, y0 double, px double, py double, xmin double, ymin double, xmax double, ymax double"


def _catalog_row(name: str, m: GridMeta | None) -> tuple:
    return (name, *[None] * 12) if m is None else (name, m.rows, m.cols, m.cell, m.epsg, m.x0, m.y0, m.px, m.py, *m.extent)


def raster_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per TIFF, by path: size, georeference and extent; nulls for what can't be read.

    Files are listed by Spark; a task opens each and reads its header by range.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    with open_at(name) as file:
                        rows.append(_catalog_row(name, tiff_meta(file)[0]))
                except (ValueError, KeyError, IndexError, struct.error):
                    rows.append(_catalog_row(name, None))
            types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
            names, kinds = zip(*(f.split() for f in CATALOG.split(", ")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(parse, CATALOG).orderBy("path")


def scan_directory(spark: SparkSession, folder: str, view: tuple[float, float, float, float] | None = None) -> DataFrame:
    """What a folder offers: path, kind (tif or zip). With a view, TIFFs that don't touch it are left out; unreadable ones and ZIPs stay."""
    names = spark.read.format("binaryFile").load(folder).select("path", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("suffix"))
    listed = names.filter(F.col("suffix").isin("tif", "tiff", "zip")).select("path", F.when(F.col("suffix") == "zip", "zip").otherwise("tif").alias("kind"))
    if view is not None:
        boxes = raster_catalog(spark, folder).select("path", "xmin", "ymin", "xmax", "ymax")
        touch = overlaps(tuple(F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")), tuple(F.lit(v) for v in view))
        listed = listed.join(boxes, "path", "left").filter((F.col("kind") == "zip") | touch).select("path", "kind")
    return listed.orderBy("path")


def merge_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Sub-folders that hold ZIPs, with their number."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder).select("path")
    inner = names.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"))
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    return inner.filter(F.col("folder").rlike(f"/{base}/[^/]+$")).groupBy("folder").agg(F.count("*").alias("files")).orderBy("folder")


def write_geotiff(grid: DataFrame, meta: GridMeta, folder: str, name: str, value: str = "z", tile: int = 1024) -> DataFrame:
    """Writes a grid as square tiles, a GeoTIFF each, by the tasks that hold them; returns their paths.

    A file has tile x tile cells at most, so that none needs the large format and no task more memory on a wider grid.
    A grid without a CRS is stamped as Web Mercator.
    """

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        pixels = np.full((min(tile, meta.rows - r0), min(tile, meta.cols - c0)), np.nan)
        pixels[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = pdf["z"].to_numpy(float)
        part = GridMeta(*pixels.shape, meta.cell, meta.x0 + c0 * meta.px, meta.y0 + r0 * meta.py, meta.px, meta.py, meta.epsg or 3857)
        return pd.DataFrame({"path": [save(folder, f"{name}_{int(key[0]):05d}_{int(key[1]):05d}.tif", tiff_bytes(pixels, part))]})

    at = [F.floor(F.col(k) / tile).cast("int").alias("t" + k) for k in ("r", "c")]
    tiles = grid.select(*at, "r", "c", F.col(value).cast("double").alias("z"))
    return tiles.groupBy("tr", "tc").applyInPandas(write, "path string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of texts with their number in the file: file, line_no, line."""
    text = F.decode("content", "UTF-8")
    return _files(spark, path).select(F.col("path").alias("file"), F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def stamp_las(data: bytes, epsg: int = pt.SURVEY_EPSG) -> bytes:
    """A LAS file with its CRS as a GeoTIFF key record; a file that has any record already is left as it is."""
    if struct.unpack_from("<I", data, 100)[0]:
        return data
    size, start = struct.unpack_from("<H", data, 94)[0], struct.unpack_from("<I", data, 96)[0]
    keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"GeoKeyDirectoryTag") + keys
    out = bytearray(data[:size] + record + data[start:])
    struct.pack_into("<II", out, 96, size + len(record), 1)
    return bytes(out)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Points of LAS files: path, x, y (double), z (float). Tasks read ranges of points, whatever a file's size."""
    return blocks.load(spark, blocks.LasBlocks, path)


_OFFERS = (((".tif", ".tiff"), "tif"), (("dem.txt",), "xyz"), ((".txt",), "xyz"), ((".las",), "las"))


def zip_members(spark: SparkSession, path: str, last: bool = False) -> DataFrame:
    """What each ZIP offers: path, member, kind (tif, xyz, las or none), the member's bytes and its world file's text.

    A TIF counts; without one, a text whose name ends in dem.txt or .txt, then LAS. Of several
    the first is taken, or the last as in survey archives, where all texts count alike.
    """

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, content in pdf.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found, names = (None, "none"), z.namelist()
                    for suffixes, kind in _OFFERS[:1] + _OFFERS[2:] if last else _OFFERS:
                        hits = [m for m in names if m.lower().endswith(suffixes)]
                        if hits:
                            found = (hits[-1 if last else 0], kind)
                            break
                    beside = (found[0] or "").lower().rsplit(".", 1)[0] + ".tfw"
                    world = next((z.read(m).decode() for m in names if m.lower() == beside), None) if found[1] == "tif" else None
                    rows.append((name, *found, z.read(found[0]) if found[0] else None, world))
            yield pd.DataFrame(rows, columns=["path", "member", "kind", "content", "world"])

    return _files(spark, path).mapInPandas(unpack, "path string, member string, kind string, content binary, world string")


def read_zipped(spark: SparkSession, path: str, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells (path, r, c, z) and catalogue of the TIFs and XYZ texts in ZIPs. A ZIP with neither raises; a TIF without a CRS, and XYZ, get 6676."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _cells(name, tiff_pixels(content.as_buffer().to_pybytes()))

    def headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [_catalog_row(n, tiff_meta(bytes(c), w)[0].stamped(pt.SURVEY_EPSG)) for n, c, w in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in CATALOG.split(", ")])

    members = zip_members(spark, path, last)
    known = F.when(F.col("kind").isin("tif", "xyz"), F.col("kind")).otherwise(F.raise_error(F.concat("path", F.lit(" has no TIF or XYZ text"))))
    members = members.withColumn("kind", known)
    tifs = members.filter("kind = 'tif'")
    text = F.split(F.decode("content", "UTF-8"), r"\r?\n")
    lines = members.filter("kind = 'xyz'").select(F.col("path").alias("file"), F.posexplode(text).alias("line_no", "line"))
    cells, catalogue = pt.latest_of_files(pt.parse_xyz(lines))
    cells = tifs.select("path", "content").mapInArrow(parse, "path string, r int, c int, z double").unionByName(cells.select(F.col("file").alias("path"), "r", "c", F.col("z").cast("double")))
    found = tifs.select("path", "content", "world").mapInPandas(headers, CATALOG)
    return cells, found.unionByName(catalogue.withColumnRenamed("file", "path").select(*found.columns))


def merge_zips(spark: SparkSession, folder: str) -> tuple[DataFrame, GridMeta]:
    """A folder of ZIPs as one grid; where files overlap the last by name wins."""
    cells, catalogue = read_zipped(spark, f"{folder.rstrip('/')}/*.zip")
    return merge(cells, catalogue)


def png_pixels(data: bytes) -> np.ndarray:
    """Rows, columns and channels of an 8-bit RGB or RGBA PNG that isn't interlaced."""
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", chunk) if kind == b"IHDR" else head
        body += chunk if kind == b"IDAT" else b""
        at += 12 + size
    w, h, depth, colour, _, _, laced = head
    if depth != 8 or colour not in (2, 6) or laced:
        raise ValueError("only plain 8-bit RGB and RGBA is read")
    n = 3 if colour == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    filters, lines = raw[:, 0], raw[:, 1:].reshape(h, w, n).astype(np.int64)
    out = np.zeros((h + 1, w + 1, n), np.int64)  # a row and a column of zeros before the first
    if filters.max(initial=0) <= 2:
        for r in range(h):
            left = np.cumsum(lines[r], 0) if filters[r] == 1 else lines[r]
            out[r + 1, 1:] = (left + (out[r, 1:] if filters[r] == 2 else 0)) & 255
        return out[1:, 1:].astype(np.uint8)
    # A pixel needs those left of it, above and between: all of a diagonal are ready at once.
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c, kind = d - r, filters[r][:, None]
        a, b, e = out[r + 1, c], out[r, c + 1], out[r, c]
        pa_, pb, pc = abs(b - e), abs(a - e), abs(a + b - 2 * e)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, e))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) // 2, paeth], 0)
        out[r + 1, c + 1] = (lines[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of elevation tiles stored as .../x/y.png: tx, ty, px, py, R, G, B."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tx, ty, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rgb = png_pixels(content.as_buffer().to_pybytes()).astype(np.int32)
                py, px = np.indices(rgb.shape[:2], dtype=np.int32)
                n = px.size
                yield pa.RecordBatch.from_pydict({"tx": pa.array(np.full(n, tx, np.int64)), "ty": pa.array(np.full(n, ty, np.int64)), "px": pa.array(px.ravel()), "py": pa.array(py.ravel()), **{k: pa.array(rgb[:, :, i].ravel()) for i, k in enumerate("RGB")}})

    number = lambda k: F.regexp_extract("path", r"(\d+)/(\d+)\.png$", k).cast("long")
    numbered = _files(spark, path).select(number(1).alias("tx"), number(2).alias("ty"), "content")
    return numbered.mapInArrow(parse, "tx long, ty long, px int, py int, R int, G int, B int")
