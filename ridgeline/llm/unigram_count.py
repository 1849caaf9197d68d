"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every piece that ends at each character; dynamic
programming carries the best score and its number of pieces, never the pieces.

Ties follow the tokenizers library's unigram model: of candidates that end at the same
character the one that starts first wins unless a later one is strictly better, and a
character that is no piece itself can be unknown at the lowest score less 10. With
byte pieces, unknown characters count their UTF-8 bytes; without, a run of unknown
characters counts one. Spaces become U+2581 and the text begins with one.

No piece has a U+2581 after another character, so a text splits before each run of
U+2581 into units whose counts add up (scores begin at 0 for each unit); a line feed,
where no piece has one, also splits. Units are remembered for each worker up to
``CACHE_UNITS``; later ones are computed each time.

The counts are those of the tokenizers library's unigram model over the pieces and scores
of the file. The public file at hand, ``piece_bpe_32k.model``, holds a BPE model, whose
scores are merge ranks (0, -1, -2, ...): over it the counts are exact for that unigram
model, but they aren't those of the BPE tokenizer that the file was made for. No unigram
vocabulary is at hand, and tokenizers are not trained here.

Null texts count as empty, and an empty text has no piece. Very long texts are counted
whole, unit by unit; one unit of n characters takes memory of some 100 n bytes. Repeated
rows and ids have their own counts. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_UNITS = 800_000
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_COUNTERS: dict[str, UnigramCounter] = {}


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.byte_pieces = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.lines_split = not any("\n" in p for p in pieces)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space mark after another character")
        self.cache: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> UnigramCounter:
        if path not in _COUNTERS:
            _COUNTERS[path] = cls(read_vocabulary(path))
        return _COUNTERS[path]

    def count_unit(self, unit: str) -> int:
        """Pieces of the best segmentation of one unit."""
        n = len(unit)
        best: list[float | None] = [0.0] + [None] * n
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        done = single = 0  # ends up to ``done`` are final; the last end that a one-character piece has

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if done != single:
                    score = best[done - 1] + self.unknown
                    if best[done] is None or score > best[done]:
                        extra = len(unit[done - 1].encode()) if self.byte_pieces else 0 if unknown[done - 1] else 1
                        best[done], count[done], unknown[done] = score, count[done - 1] + extra, True

        for last, (size, score) in self.automaton.iter(unit):
            end = last + 1
            close(end - 1)
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], count[end], unknown[end] = total, count[end - size] + 1, False
            if size == 1:
                single = end
        close(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.lines_split and "  " not in text and SPACE not in text and " \n" not in text and text[0] not in " \n":
            # A word as it stands here is the key; one after a line feed has no leading space.
            return self._sum(text.replace("\n", " \n").split(" "), spaced=True)
        return self._sum(_UNIT.findall(SPACE + text.replace(" ", SPACE)), spaced=False)

    def _sum(self, units: list[str], spaced: bool) -> int:
        cache = self.spaced if spaced else self.cache
        found = list(map(cache.get, units))
        if None in found:
            for i, c in enumerate(found):
                if c is None:
                    u = units[i]
                    found[i] = c = self.count_unit(SPACE + u if spaced and u[:1] != "\n" else u)
                    if len(cache) < CACHE_UNITS:
                        cache[u] = c
        return sum(found)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.of(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole document."""
    import public_tokenizers

    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")
