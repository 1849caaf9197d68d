"""Export bundles: a ZIP whose members tasks compress, by stretches, and one commit joins.

A member is cut into stretches of its file. A task deflates a stretch to a byte boundary,
so that the stretches of a member, one after another, are one stream; their checksums
combine without reading the bytes again. Sizes summed up in order give every member's
place, for the headers and the directory at the end. Members, places and directories
beyond 4 GB take the long form. The bundle appears under its name when it is whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.files import join_files, names_in, open_at, remove, save, size_of
from ridgeline.storage import materialise, scratch

#: Bytes of a stretch, and from where on the long form is needed.
STRETCH, LONG = 32 << 20, 0xFFFFFFFF
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two texts one after the other, the second of ``size`` bytes."""
    power, square, n = 1 << 31, 1 << 30, 8 * size  # x to the 0, and to the 1
    while n:
        power = _times(power, square) if n & 1 else power
        square, n = _times(square, square), n >> 1
    return _times(first, power) ^ second


def counted_name(folder: str, prefix: str, at: datetime | None = None) -> str:
    """``prefix_20240131-all.zip``, and ``prefix_20240131_2-all.zip`` where one is there already."""
    stem = f"{prefix}_{at or datetime.now():%Y%m%d}"
    n = sum(bool(re.fullmatch(re.escape(stem) + r".*-all\.zip", x)) for x in names_in(folder)) + 1
    return f"{stem}-all.zip" if n == 1 else f"{stem}_{n}-all.zip"


def _deflated(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                with open_at(x["path"]) as file:
                    data = file.read_at(x["size"], x["at"])
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                body = packer.compress(data) + packer.flush(zlib.Z_FINISH if x["last"] else zlib.Z_FULL_FLUSH)
                part = save(folder, f"{x['member']:06d}-{x['k']:08d}-{uuid.uuid4().hex[:12]}.part", body)
                yield pa.RecordBatch.from_pylist([{"member": x["member"], "k": x["k"], "part": part, "crc": zlib.crc32(data), "size": len(data), "packed": len(body)}], schema=pa.schema([("member", pa.int32()), ("k", pa.int32()), ("part", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("packed", pa.int64())]))

    return run


def _headers(name: bytes, crc: int, size: int, packed: int, at: int, long: int) -> tuple[bytes, bytes]:
    """A member's header and its entry in the directory."""
    wide, far = max(size, packed) >= long, at >= long
    sizes = struct.pack("<QQ", size, packed)
    fields = struct.pack("<HHHHHI", 45 if wide or far else 20, 0x0800, 8, 0, 0x21, crc)  # names in UTF-8; 1 January 1980
    short = struct.pack("<II", *((0xFFFFFFFF,) * 2 if wide else (packed, size)))
    extra = struct.pack("<HH", 1, 16) + sizes if wide else b""
    local = b"PK\3\4" + fields + short + struct.pack("<HH", len(name), len(extra)) + name + extra
    more = (sizes if wide else b"") + (struct.pack("<Q", at) if far else b"")
    extra = struct.pack("<HH", 1, len(more)) + more if more else b""
    entry = b"PK\1\2" + struct.pack("<H", 45) + fields + short + struct.pack("<HHHHHII", len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if far else at) + name + extra
    return local, entry


def _end(n: int, at: int, size: int, long: int) -> bytes:
    out = b""
    if n >= 0xFFFF or at >= long or size >= long or at + size >= long:
        out = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at) + b"PK\6\7" + struct.pack("<IQI", 0, at + size, 1)
        n, at, size = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
    return out + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, n, n, size, at, 0)


def export_bundle(spark: SparkSession, path: str, files: dict[str, str], texts: dict[str, str] | None = None, stretch: int = STRETCH, long: int = LONG) -> int:
    """Writes a ZIP of files (name in the ZIP to path) and of texts; returns its bytes.

    The driver knows a line for each stretch. An empty file is an empty member; a file that
    isn't there raises, and nothing stays behind.
    """
    folder, names, rows = scratch(spark, "bundle-parts"), [*files], []
    for m, source in enumerate(files.values()):
        size = size_of(source)
        starts = range(0, max(size, 1), stretch)
        rows += [(m, k, source, at, min(stretch, size - at), at + stretch >= size) for k, at in enumerate(starts)]
    done: dict[int, list] = {m: [] for m in range(len(names))}
    if rows:
        table = spark.createDataFrame(rows, "member int, k int, path string, at long, size long, last boolean").repartition(len(rows), F.col("member"), F.col("k"))
        made = materialise(table.mapInArrow(_deflated(folder), "member int, k int, part string, crc long, size long, packed long"), "bundle")
        for r in made.orderBy("member", "k").toLocalIterator():
            done[r.member].append(r)
    members: list[tuple[str, int, int, int, list]] = []
    for m, name in enumerate(names):
        crc, size = 0, 0
        for r in done[m]:
            crc, size = crc_joined(crc, r.crc, r.size), size + r.size
        members.append((name, crc, size, sum(r.packed for r in done[m]), [r.part for r in done[m]]))
    for name, text in (texts or {}).items():
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(text.encode()) + packer.flush()
        members.append((name, zlib.crc32(text.encode()), len(text.encode()), len(body), [body]))
    pieces, directory, at = [], b"", 0
    for name, crc, size, packed, parts in members:
        local, entry = _headers(name.encode(), crc, size, packed, at, long)
        pieces += [local, *parts]
        directory += entry
        at += len(local) + packed
    out = join_files(path, [*pieces, directory, _end(len(members), at, len(directory), long)])
    remove(folder)
    return out
