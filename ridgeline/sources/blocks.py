"""Data sources that read parts of files: blocks of GeoTIFFs and ranges of LAS points.

A partition is some blocks of one file, with the places of their bytes, so a file of any
size is read by many tasks, and each opens the file and reads its own ranges. Planning reads
headers, several files at a time. Comparisons of r and c with numbers reach the planning
where ``spark.sql.python.filterPushdown.enabled`` is set, which ``load`` does: blocks outside
have no partition. Spark still applies the predicates to the rows.

    spark.dataSource.register(TiffBlocks)
    spark.read.format("geotiff_blocks").option("paths", json.dumps(paths)).load()

Files are opened by pyarrow. ``load`` lets Spark list them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ridgeline.sources import raster
from ridgeline.sources.files import open_at

#: Cells or points of a partition, about; cells of a batch; bytes that one read spans.
PARTITION, BATCH, READ = 4 << 20, 1 << 16, 8 << 20
#: Headers that planning reads at a time.
THREADS = 16


@dataclass
class Part(InputPartition):
    """Blocks of a file: (number, offset, size) each."""

    path: str
    layout: object
    blocks: list[tuple[int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.cells = int(options.get("cells", PARTITION))
        self.bounds = {"r": [0, 1 << 62], "c": [0, 1 << 62]}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds of r and c over for planning; all filters are still applied to rows, as blocks are coarse."""
        for f in filters:
            bound = self.bounds.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if bound is not None and isinstance(getattr(f, "value", None), int):
                low, high = {GreaterThan: (f.value + 1, None), GreaterThanOrEqual: (f.value, None), LessThan: (None, f.value - 1), LessThanOrEqual: (None, f.value), EqualTo: (f.value, f.value)}.get(type(f), (None, None))
                bound[0] = bound[0] if low is None else max(bound[0], low)
                bound[1] = bound[1] if high is None else min(bound[1], high)
            yield f

    def partitions(self) -> list[Part]:
        with ThreadPoolExecutor(THREADS) as pool:
            return [p for parts in pool.map(self.parts, self.paths) for p in parts]

    def parts(self, path: str) -> list[Part]:
        raise NotImplementedError


def _ranges(blocks: list[tuple[int, int, int]], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks that lie one after another, in reads of ``most`` bytes, about."""
    run: list[tuple[int, int, int]] = []
    for b in blocks:
        if run and (b[1] != run[-1][1] + run[-1][2] or b[1] + b[2] - run[0][1] > most):
            yield run
            run = []
        run.append(b)
    if run:
        yield run


class _TiffReader(_Reader):
    def parts(self, path: str) -> list[Part]:
        with open_at(path) as file:
            layout, places, sizes = raster.tiff_layout(file)
        (r0, r1), (c0, c1) = self.bounds["r"], self.bounds["c"]
        wanted = []
        for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
            r, c, h, w = layout.window(k)
            if r <= r1 and r + h > r0 and c <= c1 and c + w > c0:
                wanted.append((k, at, size))
        step = max(1, self.cells // (layout.height * layout.width))
        return [Part(path, layout, wanted[i : i + step]) for i in range(0, len(wanted), step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with open_at(partition.path) as file:
            for run in _ranges(partition.blocks, READ):
                start = run[0][1]
                data = file.read_at(run[-1][1] + run[-1][2] - start, start)
                for k, at, size in run:
                    r0, c0, h, w = partition.layout.window(k)
                    z = partition.layout.cells(k, data[at - start : at - start + size])
                    step = max(1, BATCH // w)
                    for i in range(0, h, step):
                        yield _batch(partition.path, r0 + i, c0, z[i : i + step])


def _batch(path: str, r0: int, c0: int, z: np.ndarray) -> pa.RecordBatch:
    r, c = np.indices(z.shape, dtype=np.int32)
    columns = [pa.array([path] * z.size, pa.string()), pa.array((r + r0).ravel(), pa.int32()), pa.array((c + c0).ravel(), pa.int32()), pa.array(z.ravel(), mask=np.isnan(z).ravel())]
    return pa.RecordBatch.from_arrays(columns, ["path", "r", "c", "z"])


class TiffBlocks(DataSource):
    """Cells of GeoTIFFs, band 1: path, r, c, z."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_blocks"

    def schema(self) -> str:
        return "path string, r int, c int, z double"

    def reader(self, schema) -> _TiffReader:
        return _TiffReader(self.options)


class _LasReader(_Reader):
    def parts(self, path: str) -> list[Part]:
        with open_at(path) as file:
            head = file.read_at(375, 0)
        if head[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        offset, length = struct.unpack_from("<I", head, 96)[0], struct.unpack_from("<H", head, 105)[0]
        n = struct.unpack_from("<I", head, 107)[0] or struct.unpack_from("<Q", head, 247)[0]
        scale = struct.unpack_from("<6d", head, 131)
        return [Part(path, (length, scale), [(i, offset + i * length, (min(i + BATCH, n) - i) * length) for i in range(first, min(first + self.cells, n), BATCH)]) for first in range(0, n, self.cells)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        length, scale = partition.layout
        scale, shift = np.array(scale).reshape(2, 3)
        with open_at(partition.path) as file:
            for _, at, size in partition.blocks:
                raw = np.frombuffer(file.read_at(size, at), np.uint8).reshape(-1, length)
                xyz = np.ascontiguousarray(raw[:, :12]).view("<i4") * scale + shift
                columns = [pa.array([partition.path] * len(xyz), pa.string()), pa.array(xyz[:, 0]), pa.array(xyz[:, 1]), pa.array(xyz[:, 2].astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "x", "y", "z"])


class LasBlocks(DataSource):
    """Points of LAS files: path, x, y, z."""

    @classmethod
    def name(cls) -> str:
        return "las_blocks"

    def schema(self) -> str:
        return "path string, x double, y double, z float"

    def reader(self, schema) -> _LasReader:
        return _LasReader(self.options)


def load(spark: SparkSession, source: type[DataSource], path: str) -> DataFrame:
    """Reads the files that Spark lists under a path or pattern."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paths = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator())
    return spark.read.format(source.name()).option("paths", json.dumps(paths)).load()
