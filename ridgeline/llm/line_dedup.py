"""Line dedup: documents probe a sharded minimal perfect hash of the lines that they share.

One pass hashes every line to 128 bits (two seeds) and groups the hashes, with counts
summed before the shuffle: no line travels. Hashes found in two documents or more are
dealt to shards of about ``SHARD_KEYS``; each shard becomes a file with a minimal perfect
hash (``perfect_hash``) whose slots index three arrays: a 64-bit fingerprint, the count of
documents, and the largest id. A second pass hashes the lines again where they lie and
probes the arrays, shard by shard, for ``PROBES`` lines at a time. A task holds one chunk
of hashes and shards up to ``RESIDENT`` bytes; where the index is larger, the shards are
read once a chunk. Texts never leave their task: Python sees hashes only.

A line's key is the line without space and ``\\t\\n\\v\\f\\r`` at both ends, with A-Z
lower-cased. Keys of at least ``min_chars`` code points found in at least ``min_docs``
documents lose all their lines but those in the largest id that holds them. A line that no
other document shares is taken for a shared one with a chance of 2^-64 each (the slot's
fingerprint is the second hash); two keys have one 128-bit hash with less chance still.

Null and empty texts are one empty line. Rows are documents: rows that repeat an id count
each, and all rows of the largest id keep their lines. Null ids are smaller than all others,
and alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import blobs
from ridgeline.llm.native import ascii_lower
from ridgeline.llm.perfect_hash import Slots, build
from ridgeline.storage import materialise, scratch

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = " \t\n\x0b\x0c\r"
#: Keys of a shard, about: 5 MB of arrays.
SHARD_KEYS = 1 << 18
#: Bytes of shards that a worker keeps, and lines that it probes with at a time.
RESIDENT, PROBES = 96 << 20, 1 << 21
#: Smaller than every id: stands for null.
_NO_ID = -(1 << 63)


def line_hashes(text: Column, min_chars: int) -> Column:
    """Two 64-bit hashes of the key of each line; null for keys that are too short."""
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(_SPACE)))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


def _hashed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", line_hashes(F.col("text"), min_chars).alias("hashes"))


def _write_shard(folder: str):
    def write(table: pa.Table) -> pa.Table:
        a, b, docs, keep = (table.column(c).to_numpy() for c in ("a", "b", "docs", "keep"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        sizes, words = build(a, b)
        at = np.argsort(Slots(sizes, words).of(a, b))
        name, data = blobs.fresh_name("shard", ".npz"), io.BytesIO()
        np.savez(data, sizes=sizes, words=words, mark=b[at], docs=np.minimum(docs[at], (1 << 32) - 1).astype(np.uint32), keep=keep[at])
        with blobs.create(folder, name) as out:
            out.write(data.getbuffer())
        return pa.table({"shard": table.column("shard").slice(0, 1), "name": [name], "keys": pa.array([len(a)], pa.int64()), "bytes": pa.array([data.tell()], pa.int64())})

    return write


class LineIndex:
    """Where the shards are: a name for each, of a number that the count of keys decides."""

    def __init__(self, folder: str, shards: int, names: dict[int, str]):
        self.folder, self.shards, self.names = folder, shards, names

    def load(self, shard: int) -> tuple[Slots, np.ndarray, np.ndarray, np.ndarray]:
        with blobs.open_at(self.folder, self.names[shard]) as f, np.load(io.BytesIO(f.read())) as x:
            return Slots(x["sizes"], x["words"]), x["mark"], x["docs"], x["keep"]


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> LineIndex:
    """Indexes the keys that two documents or more share; the driver gets the shards' names alone."""
    spark = docs.sparkSession
    # In order, equal hashes stand together; array_distinct would compare all pairs of structs.
    ordered = _hashed(docs, id_col, text_col, min_chars).select("id", F.sort_array(F.filter("hashes", lambda h: h.isNotNull())).alias("hs"))
    each = ordered.select("id", F.explode(F.filter("hs", lambda h, i: (i == 0) | (h != F.get("hs", i - 1)))).alias("h"))
    counted = each.groupBy("h.a", "h.b").agg(F.count("*").alias("docs"), F.max("id").alias("keep")).filter("docs > 1")
    counted = materialise(counted, "line-counts")
    shards, folder = counted.count() // shard_keys + 1, scratch(spark, "line-shards")
    dealt = counted.withColumn("shard", F.pmod("a", F.lit(shards)))
    made = dealt.groupBy("shard").applyInArrow(_write_shard(folder), "shard long, name string, keys long, bytes long")
    return LineIndex(folder, shards, {r.shard: r.name for r in materialise(made, "line-manifest").select("shard", "name").toLocalIterator()})


def _prober(index: LineIndex, min_docs: int):
    """A UDF: which of a document's lines go."""
    resident, probes = RESIDENT, PROBES

    def drops(loaded: OrderedDict, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
        gone, shard = np.zeros(len(a), bool), np.mod(a, index.shards)
        order = np.argsort(shard, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(a) else ():
            k = int(shard[at[0]])
            if k not in index.names:
                continue
            if k not in loaded:
                loaded[k] = index.load(k)
                while len(loaded) > 1 and sum(x.nbytes for s, *rest in loaded.values() for x in (s.words, s.before, *rest)) > resident:
                    loaded.popitem(last=False)
            loaded.move_to_end(k)
            slots, mark, docs, keep = loaded[k]
            slot = slots.of(a[at].view(np.uint64), b[at].view(np.uint64))
            gone[at] = (slot >= 0) & (mark[slot] == b[at].view(np.uint64)) & (docs[slot] >= min_docs) & (keep[slot] != ids[at])
        return gone

    def answer(loaded: OrderedDict, held: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lists = [(h, h.flatten(), np.repeat(i.to_numpy(), h.value_lengths().to_numpy())) for i, h in held]
        given = [x.is_valid().to_numpy(zero_copy_only=False) for _, x, _ in lists]
        keys = [x.drop_null() for _, x, _ in lists]
        a, b = (np.concatenate([x.field(n).to_numpy() for x in keys]) for n in (0, 1))
        gone, start = drops(loaded, a, b, np.concatenate([i[g] for (_, _, i), g in zip(lists, given, strict=True)])), 0
        for (h, x, _), g in zip(lists, given, strict=True):
            mask, n = np.zeros(len(x), bool), int(g.sum())
            mask[g] = gone[start : start + n]
            start += n
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy())]), pa.int32()), pa.array(mask))

    @F.arrow_udf("array<boolean>")
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        loaded, held, lines = OrderedDict(), [], 0
        for ids, hashes in batches:
            held.append((ids, hashes))
            lines += len(hashes.flatten())
            if lines >= probes:
                yield from answer(loaded, held)
                held, lines = [], 0
        if held:
            yield from answer(loaded, held)

    return probe


def drop_lines(docs: DataFrame, index: LineIndex, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_text. ``min_docs`` is 2 at least."""
    if min_docs < 2:
        raise ValueError("a line that one document alone holds isn't indexed")
    judged = _hashed(docs, id_col, text_col, min_chars).withColumn("gone", _prober(index, min_docs)("id", "hashes"))
    out = judged.select("id", "text", "gone", F.size("gone").cast("long").alias("n_lines"), F.size(F.filter("gone", lambda g: g)).cast("long").alias("n_dropped"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.get("gone", i)), "\n")
    return out.select(F.nullif("id", F.lit(_NO_ID)).alias("id"), "n_lines", "n_dropped", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept).alias("kept_text"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``drop_lines`` with an index of the same documents."""
    return drop_lines(docs, build_index(docs, min_chars, id_col, text_col), min_docs, min_chars, id_col, text_col)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what stays of its lines."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     b AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     g AS (SELECT k.*, b.key IS NOT NULL AND k.doc_id <> b.keep AS gone FROM k LEFT JOIN b ON k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
