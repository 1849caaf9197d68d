"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame is an
independent Zstandard frame, and a skippable frame at the end holds the seek table
(the public seekable format), so any reader finds the frame of a byte offset from
the file's end. ``write_archives`` also returns an index: for each record id the
file, frame, offset in the frame and length. ``read_archives`` reads whole archives
back, ``fetch`` one record through the index.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with
the largest id is the response, the others are revisits that refer to it and carry no
payload. Equal means: same length and same SHA-256. Null payloads count as empty;
null ids are smaller than all others and written without an id. Rows that repeat both
the largest id and its payload are all responses. Null urls give no target. An empty
table gives no archive. Other columns are ignored. The index has a row for each record:
records without an id, or with a repeated one, share it there and in their header.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import blobs
from ridgeline.llm.native import mark_members, member_filter
from ridgeline.storage import materialise, scratch

FRAME_BYTES = 1 << 18
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:x-page:"
_NO_ID = -(1 << 63)


def _record(kind: str, key: int | None, url: str | None, digest: str, length: int, payload: bytes | None, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'' if key is None else key}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Appends records to frames; holds one frame in memory."""

    def __init__(self, folder: str, name: str, level: int = 3):
        import zstandard

        self.file, self.zstd = blobs.create(folder, name), zstandard.ZstdCompressor(level=level)
        self.held, self.size = [], 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length of the record."""
        if self.size and self.size + len(record) > FRAME_BYTES:
            self._flush()
        at = (len(self.frames), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        if self.held:
            data = self.zstd.compress(b"".join(self.held))
            self.file.write(data)
            self.frames.append((len(data), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.file.write(struct.pack("<II", _SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE))
        self.file.close()


class BundleReader:
    """Frames of an archive by number, through the seek table at its end."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.file, self.zstd = blobs.open_at(folder, name), zstandard.ZstdDecompressor()
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        self.sizes = [struct.unpack("<II", self.file.read(8)) for _ in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        return self.zstd.decompress(self.file.read(self.sizes[k][0]), max_output_size=max(1, self.sizes[k][1]))


def parse_records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(head["content-length"])
        yield head, frame[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _key(urn: str | None) -> int | None:
    found = (urn or "").removeprefix(f"<{_URN}").removesuffix(">")
    return int(found) if found else None


def choose_responses(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """Rows (id, url, payload, digest, length, refers_to): refers_to is null for responses, payload for revisits.

    Who refers to whom is found on ids and digests. Payloads stay where they are read,
    but for the few that a full bitmap can't tell from revisits.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # An id that is null is no larger than any other.
    key, place = F.concat_ws(":", F.octet_length("payload"), F.sha2("payload", 256)), F.coalesce("id", F.lit(_NO_ID))
    rows = rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long"), "large": F.octet_length("payload") >= min_revisit_bytes})
    large = materialise(rows.filter("large").select("id", place.alias("place"), "url", "digest", "length", key.alias("key")), "warc-digests")
    groups = large.groupBy("key").agg(F.max("place").alias("best"), F.count("*").alias("n")).filter("n > 1").select("key", "best")
    revisits = materialise(large.join(groups, "key").filter("place < best"), "warc-revisits")
    row = F.xxhash64("key", "place")
    unsure = mark_members(large.withColumn("row", row), F.col("row"), member_filter(revisits.select(row.alias("row")), "row"), "hit").filter("hit")
    unsure = materialise(unsure.join(revisits.select("key", "place").distinct(), ["key", "place"], "left_anti").select("row"), "warc-unsure")
    keyed = rows.withColumn("row", F.when(F.col("large"), F.xxhash64(key, place)))
    marked = mark_members(keyed, F.col("row"), member_filter(revisits.select(row.alias("row")), "row"), "hit")
    marked = mark_members(marked, F.col("row"), member_filter(unsure, "row"), "doubt")
    plain = marked.filter("NOT hit").select("id", "url", "payload", "digest", "length")
    rescued = marked.filter("hit AND doubt").withColumn("key", key).withColumn("place", place).join(revisits.select("key", "place").distinct(), ["key", "place"], "left_anti").select("id", "url", "payload", "digest", "length")
    responses = plain.unionByName(rescued).withColumn("refers_to", F.lit(None).cast("long"))
    return responses.unionByName(revisits.select("id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "length", F.col("best").alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000) -> DataFrame:
    """Writes the archives; returns the index (id, file, frame, offset, length)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, ""
        for batch in batches:
            if writer is None:
                name = blobs.fresh_name("pages", ".warc.zst")
                writer = BundleWriter(folder, name)
            ids, places = batch.column(0).to_pylist(), []
            for key, url, payload, digest, length, refers in zip(ids, *(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                places.append(writer.add(_record("response" if refers is None else "revisit", key, url, digest, length, payload, refers)))
            frame, offset, length = zip(*places, strict=True) if places else ((), (), ())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "file": pa.array([name] * len(ids), pa.string()), "frame": pa.array(frame, pa.int32()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})
        if writer is not None:
            writer.close()

    rows = choose_responses(pages, id_col, url_col, payload_col, min_revisit_bytes)
    return materialise(rows.mapInArrow(write, "id long, file string, frame int, offset long, length long"), "warc-index")


def fetch(index_row, folder: str) -> tuple[dict[str, str], bytes]:
    """One record through its row of the index: decompresses one frame."""
    frame = BundleReader(folder, index_row["file"]).frame(index_row["frame"])
    return next(parse_records(frame[index_row["offset"] : index_row["offset"] + index_row["length"]]))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: id, payload_bytes, payload_digest, record_type, refers_to, url, file, frame.

    Digests of responses are taken anew from the payload that was read; those of
    revisits, which have none, are in their header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                bundle = BundleReader(folder, name)
                for k in range(len(bundle.sizes)):
                    rows = []
                    for head, block in parse_records(bundle.frame(k)):
                        at = block.index(b"\r\n\r\n") + 4
                        size = int(re.search(rb"Content-Length: (\d+)", block[:at])[1])
                        known, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                        if kind == "response" and (len(block) - at != size or hashlib.sha1(block[at:]).hexdigest() != known):
                            raise ValueError(f"{name}, frame {k}: damaged record {head['warc-record-id']}")
                        rows.append((_key(head["warc-record-id"]), size, known, kind, _key(head.get("warc-refers-to")), head.get("warc-target-uri"), name, k))
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_pydict({"id": pa.array(c[0], pa.int64()), "payload_bytes": pa.array(c[1], pa.int64()), "payload_digest": pa.array(c[2], pa.string()), "record_type": pa.array(c[3], pa.string()), "refers_to": pa.array(c[4], pa.int64()), "url": pa.array(c[5], pa.string()), "file": pa.array(c[6], pa.string()), "frame": pa.array(c[7], pa.int32())})

    # Ranges of names that differ: a task for each file. Hashing names, or a plain count, would leave tasks empty or merge them.
    files = materialise(index.select("file").distinct(), "warc-files")
    n = max(1, files.count())
    schema = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, frame int"
    return files.repartitionByRange(n, "file").mapInArrow(read, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    folder = scratch(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(index, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     b AS (SELECT html, max(page_id) AS best FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN b.best IS NULL OR b.best = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.best <> p.page_id THEN b.best END AS refers_to
FROM p LEFT JOIN b ON p.html = b.html
"""
