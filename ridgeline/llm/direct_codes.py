"""Directly addressable codes for token ids, and the files that hold them.

An id is cut into 8-bit chunks from its low end. Level 0 holds the first chunk of
every id; a bitmap says which ids go on, and level 1 holds the next chunk of only
those, and so on. The place of an id's chunk at the next level is the number of
ones before it in the bitmap (its rank). A directory stores the rank at every
512th bit, so one id is read by a few bytes from each level and no block of ids is
ever decoded. A range of ids is contiguous at every level.

File: segments of at most ``SEGMENT`` ids, each a code of its own; then the index of
documents (ids, starts) and of segments; then a fixed footer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from ridgeline.llm import blobs

MAGIC = b"RDGTOK01"
SEGMENT = 1 << 20
_BLOCK = 512
_FOOT = struct.Struct("<QQQQ8s")
_HEAD = struct.Struct("<QQQQ")


def encode_segment(ids: np.ndarray) -> bytes:
    """Levels until no id goes on: ``levels`` headers, then their bytes."""
    parts, heads, rest = [], [], ids.astype(np.uint32)
    offset = 0
    while True:
        chunk = (rest & 255).astype(np.uint8)
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        heads.append(_HEAD.pack(len(rest), offset, offset + len(chunk), offset + len(chunk) + len(bits)))
        parts += [chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        offset += sum(map(len, parts[-3:]))
        rest = rest[more] >> 8
        if not len(rest):
            break
    return struct.pack("<Q", len(heads)) + b"".join(heads) + b"".join(parts)


class Segment:
    """Reads ids from the segment that starts at ``at`` of an open file."""

    def __init__(self, file, at: int):
        self.file = file
        file.seek(at)
        (levels,) = struct.unpack("<Q", file.read(8))
        self.heads = [_HEAD.unpack(file.read(_HEAD.size)) for _ in range(levels)]
        self.base = at + 8 + levels * _HEAD.size

    def _bytes(self, offset: int, n: int) -> np.ndarray:
        self.file.seek(self.base + offset)
        return np.frombuffer(self.file.read(n), np.uint8)

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit ``i``: a directory entry and at most 64 bytes of bitmap."""
        n, _, bitmap, ranks = self.heads[level]
        block = min(i, n - 1) // _BLOCK
        before = int(self._bytes(ranks + 4 * block, 4).view("<u4")[0])
        bits = np.unpackbits(self._bytes(bitmap + block * _BLOCK // 8, min(_BLOCK, n - block * _BLOCK) + 7 >> 3), bitorder="little")
        return before + int(bits[: i - block * _BLOCK].sum())

    def token(self, i: int) -> int:
        """The id at place ``i`` by direct addressing."""
        value = 0
        for level, (_, chunks, bitmap, _) in enumerate(self.heads):
            value |= int(self._bytes(chunks + i, 1)[0]) << (8 * level)
            if not self._bytes(bitmap + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids at ``start`` up to ``stop``; reads only their part of each level."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (n, chunks, bitmap, _) in enumerate(self.heads):
            if start >= stop:
                break
            out[where] |= self._bytes(chunks + start, stop - start).astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            bits = np.unpackbits(self._bytes(bitmap + first, (stop + 7) // 8 - first), bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[bits]
            start = self._rank(level, start) if start < n else n
            stop = start + len(where)
        return out


class ShardWriter:
    """Appends documents to a file of segments; holds one segment of ids at most."""

    def __init__(self, folder: str, name: str):
        self.file, self.at, self.total = blobs.create(folder, name), 0, 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.segments: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.total + self.held)
        while len(ids):
            take = ids[: SEGMENT - self.held]
            self.pending.append(take)
            self.held += len(take)
            ids = ids[len(take) :]
            if self.held == SEGMENT:
                self._flush()

    def _put(self, data: bytes) -> int:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data)

    def _flush(self) -> None:
        if self.held:
            self.segments.append((self.total, self._put(encode_segment(np.concatenate(self.pending)))))
            self.total += self.held
            self.pending, self.held = [], 0

    def close(self) -> int:
        """Ids written."""
        self._flush()
        known = np.array([d is not None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        at = self._put(ids.tobytes() + known.tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.segments, "<u8").reshape(-1, 2).tobytes())
        self._put(_FOOT.pack(at, len(self.docs), len(self.segments), self.total, MAGIC))
        self.file.close()
        return self.total


class ShardReader:
    """Documents, ranges and single ids of a file."""

    def __init__(self, folder: str, name: str):
        self.file = blobs.open_at(folder, name)
        size = self.file.size()
        self.file.seek(size - _FOOT.size)
        at, docs, segments, self.total, magic = _FOOT.unpack(self.file.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.file.seek(at)
        ids = np.frombuffer(self.file.read(8 * docs), "<i8")
        known = np.frombuffer(self.file.read(docs), np.uint8)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.starts = np.append(np.frombuffer(self.file.read(8 * docs), "<u8").astype(np.int64), self.total)
        self.segments = np.frombuffer(self.file.read(16 * segments), "<u8").reshape(-1, 2).astype(np.int64)

    def token(self, i: int) -> int:
        s = int(np.searchsorted(self.segments[:, 0], i, "right")) - 1
        return Segment(self.file, int(self.segments[s, 1])).token(i - int(self.segments[s, 0]))

    def ranges(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` up to ``stop``, a segment's part at a time."""
        s = int(np.searchsorted(self.segments[:, 0], start, "right")) - 1
        while start < stop:
            first, at = map(int, self.segments[s])
            end = min(stop, int(self.segments[s + 1, 0]) if s + 1 < len(self.segments) else self.total)
            yield Segment(self.file, at).tokens(start - first, end - first)
            start, s = end, s + 1

    def digests(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start in the file, count, crc32 of each document; each segment is read once."""
        held, upto, stream = np.zeros(0, "<u4"), 0, self.ranges(0, self.total)
        for doc, start, stop in zip(self.doc_ids, self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            crc, at = 0, start
            while at < stop:
                if at >= upto:
                    held = next(stream).astype("<u4")
                    upto += len(held)
                first = upto - len(held)
                part = held[at - first : stop - first]
                crc = zlib.crc32(part.tobytes(), crc)
                at += len(part)
            yield doc, start, stop - start, crc
