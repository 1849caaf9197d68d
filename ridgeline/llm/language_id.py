"""Language ID as inference of a mixture of languages.

Each language has a distribution over hashed byte 3-grams, counted from labelled
texts. A document is a mixture of languages: expectation-maximisation estimates the
proportions from its 3-gram counts. Then sets of languages compete: the leading one,
the two leading ones and so on are fitted anew, and the set with the best penalised
log-likelihood is taken (half of log n for each language after the first, where n
counts every third 3-gram, as neighbours overlap). The document's language is the
largest share in that set, its score that share.

Learning reads at most about ``rows_per_language`` texts of each language, chosen by a
hash of the row (all, where there are fewer). Prediction reads every whole text. The model
takes 64 kB for each language, on the driver and in every worker.

A null text, or one without a letter, is ``und`` with score 0 and no shares, as is every
text where nothing was learned. Ties go to the language that sorts first. Rows with a
null label are not learned from. Repeated rows are each learned from, and predicted
alike; a very long text is one slice of its own, with memory of some ten times its size.
Columns of the input that have the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.batches import in_slices

BUCKETS = 1 << 14
_SHIFT = np.uint32(32 - 14)
ROUNDS = 20


def gram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the byte 3-grams of the lower-cased text between two spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> _SHIFT


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Languages and, for each, its probability of every bucket."""

    languages: list[str]
    probs: np.ndarray

    def shares(self, text: str) -> list[tuple[int, float]]:
        """The chosen languages and their proportions, largest first."""
        counts = np.bincount(gram_buckets(text), minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        n, p = counts[seen].astype(float), self.probs[:, seen]
        order = np.argsort(-mixture(p, n)[0], kind="stable")
        best, found = -np.inf, []
        penalty = 0.5 * np.log(max(2.0, n.sum() / 3))
        for k in range(1, len(order) + 1):
            pi, fit = mixture(p[order[:k]], n)
            if fit - penalty * (k - 1) <= best:
                break
            best, found = fit - penalty * (k - 1), list(zip(order[:k].tolist(), pi.tolist(), strict=True))
        return sorted(found, key=lambda x: (-x[1], x[0]))


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood."""
    pi = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(ROUNDS if len(p) > 1 else 0):
        new = pi * (p @ (n / (pi @ p))) / total
        moved = np.abs(new - pi).max()
        pi = new
        if moved < 1e-4:
            break
    return pi, float(n @ np.log(pi @ p))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 5000, smoothing: float = 0.5) -> LanguageModel:
    """Counts 3-grams by language; the driver gets languages x 16384 sums."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    rate = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / v)))])
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in in_slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(gram_buckets(text), minlength=BUCKETS)
        for lang, c in sums.items():
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen)), "bucket": pa.array(seen, pa.int32()), "n": pa.array(c[seen], pa.int64())})

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    table = np.full((len(languages), BUCKETS), smoothing)
    codes = np.searchsorted(languages, sums.column("lang").to_pylist()) if sums.num_rows else np.zeros(0, int)
    np.add.at(table, (codes, sums.column("bucket").to_numpy()), sums.column("n").to_numpy())
    return LanguageModel(languages, table / table.sum(1, keepdims=True))


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input's columns and lang_pred, score, languages (array of lang, share)."""
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(T.StructType().add("lang", "string").add("share", "double")))
    docs = docs.drop(*added.names)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in in_slices(batches):
            found = [model.shares(t) if model.languages and has_letter(t) else [] for t in batch.column(at).to_pylist()]
            named = [[{"lang": model.languages[k], "share": min(1.0, s)} for k, s in x] for x in found]
            new = [pa.array([x[0]["lang"] if x else "und" for x in named], pa.string()), pa.array([x[0]["share"] if x else 0.0 for x in named], pa.float64()), pa.array(named, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *added.fields]))


def is_held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text divisible by 5, or no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~is_held_out()))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
