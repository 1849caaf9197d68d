"""Removal of repeated substrings: every byte of a 100-byte string that also starts earlier.

1. Anchors. A window is any ``length`` bytes of a document. Of the hashes of its
   ``KMER``-byte strings the least (the first of equals) is its anchor, so equal
   windows have equal anchors at the same place. Windows with one anchor are
   neighbours; one row stands for each such run.
2. Runs whose anchor is nowhere else can't repeat. A bitmap of fixed size of the
   anchors that occur twice drops them (when it fills up, fewer are dropped).
3. Runs with equal anchor and equal bytes are one class: all but its earliest run
   repeat in full. Equal means two equal 64-bit hashes, of the anchor and of the run;
   bytes aren't compared, and runs that differ pass for equal with a chance of 2^-128 a pair.
4. Where an anchor has several classes, the bytes of each class's earliest run go to
   one task by anchor. There a Burrows-Wheeler transform of the runs' bytes is expanded
   to the classes of suffixes with ``length`` common bytes (see ``bwt``), and all but the
   earliest window of a class repeat.
5. An anchor with more than ``HOT`` classes is parted first: its windows by ranges of
   their place about the anchor and by the bytes that all windows of a range share, 86 of
   100 with four ranges. Parts that still have more than ``HOT`` runs are parted again by
   finer ranges, and at last by single places, where the shared bytes are the whole window:
   those are grouped by their bytes. All other parts go through the same transform.
6. Each document's repeated ranges are united, and cut out of its text by Spark's own
   functions: documents without such ranges are left as they are.

Texts are UTF-8 bytes; null counts as empty; windows never cross documents. Order is by
id (null first), then position. Rows that repeat an id with another text are documents
of their own, ordered by a checksum of the text; rows alike in id and text are the same
document and get the same result. An empty table gives an empty result. Other columns
are ignored. A task needs memory of some 60 times its longest text. Texts go to Python
a thousand rows at a time, a task has one Python worker, and a worker sorts runs of a
quarter of a megabyte at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.batches import in_slices, small_batches
from ridgeline.llm.bitmaps import bitmap, has
from ridgeline.llm.bwt import class_starts
from ridgeline.llm.native import mark_members, member_filter
from ridgeline.llm.shingles import BYTE_HASH, power_tables, mix64, slices
from ridgeline.storage import in_groups, materialise

KMER = 40
#: Classes of an anchor beyond which its runs are parted by further bytes, and into how many ranges of places, round by round; then by single places.
HOT, RANGES = 2000, (4, 16)
_NO_ID = -(1 << 63)
#: Bytes of runs that a transform takes at once, and more if one anchor has more; it needs some 150 times as many.
_TEXT_BYTES = 1 << 18
_END = 255  # a byte that UTF-8 never has


def _sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    up, down = power_tables(len(buffer) + 1)
    return buffer, np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[buffer] * up[: len(buffer)], dtype=np.uint64)]), down


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For each run of windows: text number, start in the text, windows, anchor hash, hash of the run's bytes."""
    buffer, sums, down = _sums(texts)
    n = len(buffer) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    kmers = mix64((sums[KMER:] - sums[:-KMER]) * down[: len(buffer) - KMER + 1])
    least = kmers & np.uint64(0xFFFFFFFF00000000) | np.arange(len(kmers), dtype=np.uint64)
    width, have = length - KMER + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    stops = np.cumsum([len(t) for t in texts])
    inside = np.ones(n, bool)
    for stop in stops[:-1].tolist():
        inside[max(0, stop - length + 1) : stop] = False
    where = np.flatnonzero(inside)
    if not len(where):
        return runs_of([], length)
    anchors = at[where]
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    windows = np.diff(np.append(first, len(where)))
    start, anchor = where[first], anchors[first]
    text = np.searchsorted(stops, start, "right")
    whole = (sums[start + windows - 1 + length] - sums[start]) * down[start]
    content = mix64(whole ^ mix64((windows << 20 | anchor - start).astype(np.uint64)))
    return text, start - (stops[text] - np.array([len(t) for t in texts])[text]), windows, kmers[anchor], content


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    ids = [_NO_ID if d is None else d for d in batch.column(0).to_pylist()]
    texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
    for a, b in slices(texts):
        yield ids[a:b], [zlib.crc32(t) for t in texts[a:b]], texts[a:b]


def _run_key(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray, sub: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix64(anchor ^ mix64(content ^ mix64(ids.astype(np.uint64) ^ mix64((sub << 32 ^ start).astype(np.uint64)))))


_RUN = "anchor long, content long, doc long, sub long, start long, windows int"


def _run_columns(ids: list[int], subs: list[int], runs: tuple, keep: np.ndarray) -> dict[str, pa.Array]:
    text, start, windows, anchor, content = (x[keep] for x in runs)
    return {
        "anchor": pa.array(anchor.view(np.int64)),
        "content": pa.array(content.view(np.int64)),
        "doc": pa.array(np.array(ids, np.int64)[text]),
        "sub": pa.array(np.array(subs, np.int64)[text]),
        "start": pa.array(start),
        "windows": pa.array(windows.astype(np.int32)),
    }


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs whose anchor occurs at least twice."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for _, _, texts in _documents(batch):
                found = runs_of(texts, length)[3]
                # A short hash is enough to tell anchors that can be dropped.
                yield pa.RecordBatch.from_pydict({"anchor": pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))})

    twice = docs.mapInArrow(anchors, "anchor int").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(twice.select(F.col("anchor").cast("long").alias("anchor")), "anchor"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for ids, subs, texts in _documents(batch):
                found = runs_of(texts, length)
                yield pa.RecordBatch.from_pydict(_run_columns(ids, subs, found, np.flatnonzero(has(shared.value, found[3]))))

    found = materialise(docs.mapInArrow(runs, _RUN), "repeat-runs")
    shared.destroy()
    return found


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs with their bytes, read from the documents anew, and their anchor's number of classes."""
    key = F.xxhash64("anchor", "content", "doc", "sub", "start")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for ids, subs, texts in _documents(batch):
                found = runs_of(texts, length)
                text, start, windows = found[:3]
                keys = _run_key(found[3], found[4], np.array(ids, np.int64)[text], np.array(subs, np.int64)[text], start)
                keep = np.flatnonzero(has(shared.value, keys))
                data = [texts[t][s : s + w - 1 + length] for t, s, w in zip(text[keep].tolist(), start[keep].tolist(), windows[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(_run_columns(ids, subs, found, keep) | {"bytes": pa.array(data, pa.binary())})

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, content, doc, sub, start = (c.to_numpy() for c in batch.columns[:5])
            yield pa.RecordBatch.from_pydict({"key": pa.array(_run_key(anchor.view(np.uint64), content.view(np.uint64), doc, sub, start).view(np.int64))})

    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("anchor", "content", "doc", "sub", "start").mapInArrow(keyed, "key long"), "key"))
    # The bitmap lets a few others through.
    found = docs.mapInArrow(runs, _RUN + ", bytes binary").withColumn("key", key).join(wanted.select(key.alias("key"), "classes"), "key").drop("key")
    found = materialise(found, "repeat-bytes")
    shared.destroy()
    return found


def repeated_windows(rows: list[tuple[int, int, int, int, bytes]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Of runs (doc, sub, start, windows, bytes): ranges (doc, sub, start, stop) of windows with an earlier equal."""
    rows = list(dict.fromkeys(rows))  # documents alike in id and text are one
    text = np.frombuffer(b"".join(r[4] + bytes([_END]) for r in rows), np.uint8)
    begins = np.cumsum([0] + [len(r[4]) + 1 for r in rows[:-1]])
    windows = np.array([r[3] for r in rows])
    number = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows)
    doc, sub, start = (np.array([r[k] for r in rows], np.int64)[number] for k in range(3))
    order = np.lexsort((start + offset, sub, doc))
    age = np.full(len(text) + 1, -1, np.int64)
    place = begins[number] + offset
    age[place[order]] = np.arange(len(order))
    suffixes, begin = class_starts(text, length)
    ages = age[suffixes]
    own = np.flatnonzero(ages >= 0)
    classes, ages = np.cumsum(begin)[own], ages[own]
    least = np.minimum.reduceat(ages, np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])))
    late = np.sort(ages[ages != least[np.cumsum(np.concatenate([[False], classes[1:] != classes[:-1]]))]])
    at = order[late]  # in order of document and position
    d, s, p = doc[at], sub[at], (start + offset)[at]
    if not len(at):
        return
    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (p[1:] > p[:-1] + length)]))
    stop = p[np.append(cut[1:], len(p)) - 1] + length
    yield from zip(d[cut].tolist(), s[cut].tolist(), p[cut].tolist(), stop.tolist(), strict=True)


_RANGE = "doc long, sub long, start long, stop long"


def _ranges(rows) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("doc", "sub", "start", "stop"), c, strict=True)})


def _expanded(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held, size, last = [], 0, None
    for batch in in_slices(batches):
        for anchor, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if size >= _TEXT_BYTES and anchor != last:
                yield _ranges(repeated_windows(held, length))
                held, size = [], 0
            held.append(tuple(row))
            size += len(row[4]) + 1
            last = anchor
    if held:
        yield _ranges(repeated_windows(held, length))


def _by_transform(runs: DataFrame, length: int, size: int) -> DataFrame:
    """Runs with bytes, all of an anchor in one task, to repeated ranges."""
    runs = in_groups(runs.select("anchor", "doc", "sub", "start", "windows", "bytes"), "anchor", size)
    return runs.mapInArrow(lambda batches: _expanded(batches, length), _RANGE)


def _places(anchors: list[int], runs: list[bytes], length: int) -> list[int]:
    """Where in the runs their anchor is."""
    found, top = [], np.uint64(32)
    for anchor, data in zip(anchors, runs, strict=True):
        _, sums, down = _sums([data[:length]])
        kmers = mix64((sums[KMER:] - sums[:-KMER]) * down[: length - KMER + 1])
        found.append(int(np.argmax(kmers >> top == np.array([anchor], np.int64).view(np.uint64)[0] >> top)))
    return found


_PART = "anchor long, doc long, sub long, start long, windows int, bytes binary, at int"


def _split(runs: DataFrame, length: int, ranges: int) -> DataFrame:
    """Runs with bytes to shorter runs, each under a key of further bytes in place of its anchor.

    A window's place is the distance of its anchor from its start. All windows of a range
    of places hold the same stretch of bytes about the anchor, which is hashed with it:
    equal windows still meet, and those that differ in the stretch part. Runs without the
    column ``at`` are whole, and have an anchor's hash to find it by.
    """
    places = length - KMER + 1
    edges = [places * k // ranges for k in range(ranges + 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row gives up to one for each range.
        for batch in in_slices(batches):
            rows, columns = [], [c.to_pylist() for c in batch.columns]
            if "at" not in batch.schema.names:
                columns.append(_places(columns[0], columns[5], length))
            for anchor, doc, sub, start, windows, data, at in zip(*columns, strict=True):
                for lo, hi in zip(edges, edges[1:], strict=False):
                    first, last = max(0, at - hi + 1), min(windows, at - lo + 1)
                    if first < last:
                        stretch = data[at - lo : at + length - hi + 1]
                        key = hashlib.blake2b(stretch + bytes([lo]), digest_size=8, key=anchor.to_bytes(8, "little", signed=True)).digest()
                        rows.append((int.from_bytes(key, "little", signed=True), doc, sub, start + first, last - first, data[first : last - 1 + length], at - first))
            c = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds, strict=True)], ["anchor", "doc", "sub", "start", "windows", "bytes", "at"])

    return runs.mapInArrow(cut, _PART)


def _parted(crowded: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Crowded runs with bytes, as parts of ``HOT`` runs at most by key, and as ranges of those that no range of places parts."""
    calm, parts = [], crowded.select("anchor", "doc", "sub", "start", "windows", "bytes")
    for ranges in RANGES:
        parts = materialise(_split(parts, length, ranges), "repeat-parts")
        hot = materialise(parts.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"), "repeat-hot")
        calm.append(parts.join(hot, "anchor", "left_anti").select("anchor", "doc", "sub", "start", "windows", "bytes"))
        if hot.isEmpty():
            return calm, []
        parts = parts.join(hot, "anchor", "left_semi").select("anchor", "doc", "sub", "start", "windows", "bytes", "at")
    # Single windows: those of equal bytes are one class.
    alone, place = materialise(_split(parts, length, length - KMER + 1), "repeat-windows"), F.struct("doc", "sub", "start")
    firsts = alone.groupBy("anchor", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = alone.join(firsts, ["anchor", "bytes"]).filter(place != F.col("first"))
    return calm, [later.select("doc", "sub", "start", (F.col("start") + length).alias("stop"))]


def repeated_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """Rows (id, text) to ranges (doc, sub, start, stop) that earlier strings cover; ranges may overlap."""
    runs = repeated_runs(docs, length)
    place = F.struct("doc", "sub", "start")
    firsts = materialise(runs.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.first("windows").alias("windows"), F.count("*").alias("n")), "repeat-classes")
    copied = firsts.filter("n > 1").select("anchor", "content", "first")
    later = runs.join(copied, ["anchor", "content"]).filter(place != F.col("first")).select("doc", "sub", "start", (F.col("start") + F.col("windows") - 1 + length).alias("stop"))
    crowds = firsts.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1")
    wanted = materialise(firsts.join(crowds, "anchor").select("anchor", "content", "first.*", "windows", "classes"), "repeat-crowds")
    runs = _with_bytes(docs, wanted, length)
    parts, crowded = runs.filter(F.col("classes") <= HOT).drop("content", "classes"), runs.filter(F.col("classes") > HOT)
    calm, settled = ([], []) if crowded.isEmpty() else _parted(crowded, length)
    for part in calm:
        parts = parts.unionByName(part)
    ranges = later.unionByName(_by_transform(parts, length, runs.count() * 2 * length))
    for more in settled:
        ranges = ranges.unionByName(more)
    return ranges


_SPANS = "array<struct<start:long,stop:long>>"


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, sub, ranges), each range list as the longest runs of bytes that it covers, in order."""
    for batch in in_slices(batches):
        ranges = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), ranges.value_lengths().to_numpy())
        start, stop = (ranges.flatten().field(k).to_numpy() + (row << 32) for k in range(2))
        order = np.argsort(start)
        start, reach = start[order], np.maximum.accumulate(stop[order])
        first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(row) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        offsets = np.searchsorted(row[order][first], np.arange(batch.num_rows + 1))
        spans = pa.StructArray.from_arrays([pa.array(x & 0xFFFFFFFF) for x in (start[first], reach[last])], ["start", "stop"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["doc", "sub", "spans"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (removed, array of start and stop), kept (the other bytes)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        ranges = repeated_ranges(rows, length)
        # At most a range for each anchor of a document.
        by_doc = ranges.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
        by_doc = materialise(by_doc.mapInArrow(_united, f"doc long, sub long, spans {_SPANS}"), "repeat-ranges")
    doc, sub = F.coalesce("id", F.lit(_NO_ID)), F.crc32(F.col("text").cast("binary"))
    keyed = mark_members(rows.withColumns({"doc": doc, "sub": sub}), F.xxhash64("doc", "sub"), member_filter(by_doc.select(F.xxhash64("doc", "sub").alias("key")), "key"), "touched")
    data, none = F.col("text").cast("binary"), F.array().cast(_SPANS)
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    untouched = keyed.filter("NOT touched").select("id", n_bytes, none.alias("spans"), data.alias("kept"))
    touched = keyed.filter("touched").join(by_doc, ["doc", "sub"], "left").select("id", "text", n_bytes, F.coalesce("spans", none).alias("spans"))
    begins, ends = F.concat(F.array(F.lit(0).cast("long")), "spans.stop"), F.concat("spans.start", F.array("n_bytes"))

    def between(whole: Column) -> Column:
        # Strings may be joined, and hold any bytes.
        return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(whole, (a + 1).cast("int"), (b - a).cast("int")).cast("string")), "").cast("binary")

    # As an item of an array the text is copied once, and not for each span.
    return untouched.unionByName(touched.select("id", "n_bytes", "spans", F.transform(F.array(data), between)[0].alias("kept")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
