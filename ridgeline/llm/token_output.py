"""Token-id output: documents become files of directly addressable codes.

``write_tokens`` range-partitions the documents by id, encodes each whole text and
writes one file per partition in ascending id order. Its manifest has a row for each
file; the first id of a file in the whole corpus is a running sum over that small
table. ``read_digests`` opens the files again, one task a file.

Null texts count as empty and still get the end id. Null ids sort first. Rows that
repeat an id stay apart, in an order fixed by their text. An empty table gives no
file and no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import blobs
from ridgeline.llm.batches import in_slices, small_batches
from ridgeline.llm.direct_codes import ShardReader, ShardWriter
from ridgeline.llm.wordcodes import WordEncoder
from ridgeline.storage import enough, materialise, scratch

#: Bytes of text that are encoded at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def _slices(ids: list, texts: list) -> Iterator[tuple[list, list[bytes]]]:
    some, held, size = [], [], 0
    for d, t in zip(ids, texts, strict=True):
        some.append(d)
        held.append((t or "").encode() if not isinstance(t, bytes) else t)
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield some, held
            some, held, size = [], [], 0
    if some:
        yield some, held


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to ``folder``; returns the manifest (part, file, n_docs, n_tokens, first_token)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, name = WordEncoder.of(tokenizer), None, ""
        end = np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches):
            for ids, texts in _slices(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                if writer is None:
                    name = blobs.fresh_name("tokens", ".dac")
                    writer = ShardWriter(folder, name)
                for d, code in zip(ids, encoder.encode([t or b"" for t in texts]), strict=True):
                    writer.add(d, np.frombuffer(code + end, "<u4"))
        if writer is not None:
            total = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark, order = docs.sparkSession, ("id", F.xxhash64("text"))
    # A task gets 64 MB of text, about: adaptive execution never raises a number of partitions.
    parts = enough(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    more = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (rows.repartitionByRange(parts, *order) if more else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    with small_batches(spark):
        files = materialise(ranged.mapInArrow(write, "part int, file string, n_docs long, n_tokens long"), "token-files")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row a file: this window is over the manifest alone.
    return files.withColumn("first_token", F.coalesce(before, F.lit(0)))


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start in the corpus, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(zip(*ShardReader(folder, name).digests(), strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(rows[0], pa.int64()),
                    "start": pa.array(np.array(rows[1], np.int64) + first),
                    "n_tokens": pa.array(rows[2], pa.int64()),
                    "ids_crc32": pa.array(rows[3], pa.int64()),
                })

    files = manifest.select("file", "first_token")
    n = max(1, files.count())
    return files.repartitionByRange(n, "first_token").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written and read back."""
    import public_tokenizers

    return tokens_of(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def tokens_of(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read_digests(write_tokens(docs, tokenizer, end_id, folder), folder)
