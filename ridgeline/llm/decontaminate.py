"""Benchmark decontamination by latent semantic retrieval.

The corpus is read as overlapping passages of ``PASSAGE`` words. Passages and items are
TF-IDF vectors over the words of the benchmark: a word that no item has can't add to an
inner product with one, so it only counts in a passage's length (with the mean weight
of an item's word). Document frequencies are counted over all documents.

The latent space is a randomised SVD, distributed over Spark tasks: each returns its
part of A'A times a random matrix W in blocks of rows that further tasks add up; the
singular vectors follow from A'AW and W'A'AW (Nystrom), so one pass does. A has every
passage of every document, and the items, weighted to a thousand times the passages' energy: the space holds the items
nearly whole, and its cosine comes near the plain one. (A space of the corpus's own
directions was tried and can't tell the items' passages from others here; the README has
the figures.) Nothing is fitted on a sample.

A passage goes on to an item if its cosine in the latent space, plus the most that the
parts outside the space can add (the product of their lengths), reaches ``min_cosine``.
So the search loses no pair whose full TF-IDF cosine reaches it, whatever the rank.
(Passages whose words can't add up to that cosine with any item aren't projected.)

A short item, or one of common words, can stay under any cosine in a passage that holds
it whole. So a passage also goes on to an item if the words around it have, in any
order and each as often as the item at most, as many of the item's rarest words as the
rule below can't do without. Thus every pair of passage and item that meets the rule is
looked at, and frequent words cost nothing. It follows that the latent search adds no pair
to the result: what it gives is each pair's ``cosine``, a closeness of the whole passage
to the item that the subsequence doesn't tell, by which findings can be sorted or held to
a stricter threshold.

In the words around a passage the longest common subsequence with the item is taken.
The document holds the item if the subsequence has ``strict`` of the item's words, or
``loose`` of them and ``answer_share`` of its answer. Without an answer column the
answer is the item's rarest fifth of words, three at least.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text.
Null texts have none. Items of fewer than ``MIN_WORDS`` words are found where their words
stand one after another; items without a word are nowhere. Items longer than ``LONG`` words are searched for by
overlapping pieces. Items with equal text are found separately. Repeated documents have
rows of their own. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.batches import in_slices, small_batches
from ridgeline.storage import TASK_BYTES, materialise

PASSAGE, STRIDE, LONG = 48, 24, 64
#: Items of fewer words are found as phrases.
MIN_WORDS = 5
#: Of an item's words one in so many must be met beyond those that the rule lets it lack.
SPARE = 8
#: Items, and bytes of their texts, that are searched for in one pass over the corpus, about; further ones take further passes.
BLOCK_ITEMS, BLOCK_BYTES = 512, 200_000
OVERSAMPLE = 8
#: The items' energy in the fit, as a multiple of the passages'.
ITEM_WEIGHT = 1000.0
MAX_RANK = 640
_SLICE_WORDS = 20_000
#: Passages that are taken at once, and those among them that are counted as one matrix: few, so that they have few different words.
_SLICE_PASSAGES, _NEAR_PASSAGES = 1024, 64
#: Bytes of a word with its white space, about.
_WORD_BYTES = 7
#: Share of the largest singular value's square under which rounding decides.
_NOISE = 1e-7
#: Rows of a matrix that are added up as one.
_BLOCK_ROWS = 8
#: Passages times items that are counted at once.
_CELLS = 1 << 20

_TABLE = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TABLE).split()


@dataclass
class Items:
    """A block of benchmark items and what the search needs of them."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]
    answers: list[np.ndarray] = field(default_factory=list)
    pieces: list[tuple[int, np.ndarray]] = field(default_factory=list)
    idf: np.ndarray | None = None
    other: float = 1.0
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    lost: np.ndarray | None = None
    pushed: np.ndarray | None = None
    most: np.ndarray | None = None
    #: For each word the items that it is a rare one of and how often, as offsets and lists; of each item how many of these it needs, and its reach in strides.
    heads: np.ndarray | None = None
    holders: np.ndarray | None = None
    times: np.ndarray | None = None
    needs: np.ndarray | None = None
    reaches: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.vocabulary)

    def read(self, text: str | None) -> np.ndarray:
        """A text's word numbers; a word that no item has is the number ``size``."""
        w = words_of(text)
        return np.fromiter(map(self.vocabulary.get, w, repeat(self.size)), np.int32, len(w))


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[str | None]:
    """The second column, without a batch's texts being there all at once."""
    for batch in in_slices(batches):
        yield from batch.column(1).to_pylist()


def read_items(rows: list[tuple[int, str | None, str | None]]) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, words, answers = [], [], []
    for key, text, answer in rows:
        w = words_of(text)
        if w:
            ids.append(key)
            words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int32))
            answers.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in words_of(answer)], np.int32))
    items = Items(ids, words, vocabulary, answers)
    for k, w in enumerate(words):
        spans = [(0, len(w))] if len(w) <= LONG else [(s, s + PASSAGE) for s in range(0, len(w) - PASSAGE + STRIDE, STRIDE)]
        items.pieces += [(k, w[a:b]) for a, b in spans]
    return items


def document_frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int, int]:
    """For each word of the block its number of documents, and all documents and their words; the driver gets a row a word."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        sums = np.zeros(items.size + 3, np.int64)
        for text in texts_of(batches):
            ids = items.read(text)
            sums[:-2] += np.bincount(ids, minlength=items.size + 1) > 0
            sums[-2:] += 1, len(ids)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.int32()), "n": pa.array(sums[seen])})

    with small_batches(docs.sparkSession):
        rows = docs.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(items.size + 3, np.int64)
    for r in rows:
        sums[r.word] = r.n
    return sums[: items.size], int(sums[-2]), int(sums[-1])


def weigh(items: Items, frequencies: np.ndarray, documents: int) -> None:
    idf = np.log((1 + documents) / (1 + frequencies)) + 0.1
    items.other = float(np.mean(np.concatenate([idf[w] for w in items.words])))
    # The last two: words that no item has, and padding.
    items.idf = np.concatenate([idf, [0.0, 0.0]]).astype(np.float32)
    for k, w in enumerate(items.words):
        if not len(items.answers[k]):
            rare = np.argsort(-idf[w], kind="stable")[: max(3, len(w) // 5)]
            items.answers[k] = w[np.sort(rare)]


def is_phrase(words: np.ndarray) -> bool:
    """Whether an item is so short that it must stand in a text as it is."""
    return len(words) < MIN_WORDS


def least_common(length: int, share: float) -> int:
    """The fewest words in common that are ``share`` of an item's; all of a phrase."""
    if length < MIN_WORDS:
        return length
    return next((n for n in range(length + 1) if n / length >= share), length + 1)


def list_words(items: Items, share: float) -> None:
    """Lists, for each word that is among an item's rarest, the items and how often they have it.

    What holds ``share`` of an item's words can lack only the rest of them. So of the
    item's rarest words, one in ``SPARE`` more than may be lacking, it has that many more.
    """
    listed, items.needs = [], np.zeros(len(items.words), np.int64)
    for k, words in enumerate(items.words):
        w, times = np.unique(words, return_counts=True)
        order = np.argsort(-items.idf[w], kind="stable")
        total = np.cumsum(times[order])
        lacking = len(words) - least_common(len(words), share)
        n = min(int(np.searchsorted(total, lacking + max(1, len(words) // SPARE))) + 1, len(w))
        items.needs[k] = total[n - 1] - lacking
        listed.append((w[order[:n]], times[order[:n]]))
    word, times = (np.concatenate(x) for x in zip(*listed, strict=True))
    holder = np.repeat(np.arange(len(listed)), [len(w) for w, _ in listed])
    order = np.argsort(word, kind="stable")
    items.holders, items.times = holder[order], times[order]
    items.heads = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=items.size + 1))])
    items.reaches = np.array([-(-len(w) // STRIDE) for w in items.words])


def overlaps(items: Items, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(text, passage, item) whose span has as many of the item's rarest words, in any order, as the rule can't do without."""
    passages = np.array([max(1, -(-(len(t) - PASSAGE) // STRIDE) + 1) for t in texts])
    lows = np.concatenate([[0], np.cumsum(passages)])
    text = np.repeat(np.arange(len(texts)), passages)
    ids = np.concatenate(texts)
    block = np.concatenate([np.arange(len(t)) // STRIDE for t in texts])
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    known = (np.diff(items.heads) > 0)[ids]
    # A word once for each block that has it, with its number of times.
    base = int(block.max(initial=0)) + 1
    cells, many = np.unique((of[known] * base + block[known]) * items.size + ids[known], return_counts=True)
    word, block, of = cells % items.size, cells // items.size % base, cells // items.size // base
    for reach in np.unique(items.reaches):
        group = items.reaches == reach
        listed = np.flatnonzero(group[items.holders])
        # Heads of the lists that hold this group's items alone.
        heads = np.searchsorted(listed, items.heads)
        used = np.flatnonzero(heads[word + 1] > heads[word])
        mine, column = np.flatnonzero(group), np.cumsum(group) - 1
        step = max(1, _CELLS // len(mine))
        for first in range(0, len(text), step):
            last = min(len(text), first + step)
            # The passages whose spans have the block, within the text.
            low = np.maximum(lows[of[used]] + np.maximum(0, block[used] - PASSAGE // STRIDE + 1 - reach), first)
            high = np.minimum(np.minimum(lows[of[used]] + block[used] + reach + 1, lows[of[used] + 1]), last)
            width = np.maximum(0, high - low)
            at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
            keys, back = np.unique((at - first) * items.size + np.repeat(word[used], width), return_inverse=True)
            count = np.bincount(back, np.repeat(many[used], width), len(keys))
            w, passage = keys % items.size, keys // items.size
            sizes = heads[w + 1] - heads[w]
            entry = listed[np.repeat(heads[w] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            common = np.minimum(np.repeat(count, sizes), items.times[entry])
            cell = np.repeat(passage, sizes) * len(mine) + column[items.holders[entry]]
            total = np.bincount(cell, common, (last - first) * len(mine)).reshape(-1, len(mine))
            for p, k in zip(*np.nonzero(total >= items.needs[mine]), strict=True):
                d = int(text[first + p])
                yield d, int(first + p - lows[d]), int(mine[k])


def _rows_of(ids: np.ndarray) -> np.ndarray:
    """The passages of a text, padded with -1 to a row each."""
    n = max(1, math.ceil((len(ids) - PASSAGE) / STRIDE) + 1)
    padded = np.concatenate([ids, np.full((n - 1) * STRIDE + PASSAGE - len(ids), -1, np.int32)]) if len(ids) < (n - 1) * STRIDE + PASSAGE else ids
    return np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)[::STRIDE][:n]


def _energy(items: Items, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared length of each passage within the items' words, and of the whole passage."""
    s = np.sort(rows, axis=1)
    at = np.arange(s.shape[1])
    begins = np.concatenate([np.zeros((len(s), 1), int), np.where(s[:, 1:] != s[:, :-1], at[1:], 0)], 1)
    run = at - np.maximum.accumulate(begins, axis=1)
    inside = ((items.idf[s] ** 2) * (2 * run + 1)).sum(1)  # odd numbers up to the count add up to its square
    return inside, inside + (s == items.size).sum(1) * items.other**2


def _weighted(items: Items, matrix: np.ndarray) -> np.ndarray:
    """A matrix that has a row for each word, times their weights, and zeros for other words and padding."""
    return np.concatenate([matrix * items.idf[: items.size, None], np.zeros((2, matrix.shape[1]), np.float32)]).astype(np.float32)


def _counts(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The items' words that some passages have, and how often each passage has each."""
    known = (rows >= 0) & (rows < size)
    ids, place = rows[known], np.zeros(size, np.int64)
    place[ids] = 1
    words = np.flatnonzero(place)
    place[words] = np.arange(len(words))
    cells = np.repeat(np.arange(len(rows)) * len(words), known.sum(1)) + place[ids]
    return words, np.bincount(cells, minlength=len(rows) * len(words)).reshape(len(rows), len(words)).astype(np.float32)


def _project(rows: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """TF-IDF rows (not normalised) times the matrix that ``weighted`` is of."""
    out = np.empty((len(rows), weighted.shape[1]), np.float32)
    for at in range(0, len(rows), _NEAR_PASSAGES):
        words, counts = _counts(rows[at : at + _NEAR_PASSAGES], len(weighted) - 2)
        out[at : at + _NEAR_PASSAGES] = counts @ weighted[words]
    return out


def passages_of(items: Items, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """All passages of the texts, some at a time."""
    held, n = [], 0
    for text in texts:
        rows = _rows_of(items.read(text))
        for at in range(0, len(rows), _SLICE_PASSAGES):
            held.append(rows[at : at + _SLICE_PASSAGES])
            n += len(held[-1])
            if n >= _SLICE_PASSAGES:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _units(items: Items) -> Iterator[tuple[int, np.ndarray]]:
    """The pieces as unit TF-IDF vectors, a few at a time, with the number of the first."""
    for at in range(0, len(items.pieces), 64):
        part = items.pieces[at : at + 64]
        y = np.zeros((len(part), items.size), np.float32)
        for k, (_, w) in enumerate(part):
            np.add.at(y[k], w, items.idf[w])
        yield at, y / np.linalg.norm(y, axis=1, keepdims=True)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks' blocks of rows, added up."""
    sums: dict[int, np.ndarray] = {}
    energies: dict[int, float] = {}
    for batch in batches:
        for block, m, energy in zip(*batch.columns, strict=True):
            k, m = block.as_py(), np.frombuffer(m.as_buffer(), np.float32)
            sums[k] = sums[k] + m if k in sums else m.astype(np.float64)
            energies[k] = energies.get(k, 0.0) + energy.as_py()
    yield _blocks(sums, energies)


def _blocks(sums: dict[int, np.ndarray], energies: dict[int, float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array(list(sums), pa.int32()),
        "m": pa.array([m.astype(np.float32).tobytes() for m in sums.values()], pa.binary()),
        "energy": pa.array([energies.get(k, 0.0) for k in sums], pa.float64()),
    })


def fit_basis(docs: DataFrame, items: Items, words: int, rank: int | None = None) -> None:
    """Sets the latent space by a distributed pass over all passages of the documents, which have so many words.

    What a task returns is as large as the matrix. So tasks aren't more than the cores or
    the bytes call for, and the words' rows are dealt to other tasks to be added up: the
    driver gets one matrix, whatever the corpus.
    """
    spark = docs.sparkSession
    rank = min(rank or len(items.pieces) + 64, items.size, MAX_RANK)
    width = min(items.size, rank + OVERSAMPLE)
    tasks = max(3 * spark.sparkContext.defaultParallelism, math.ceil(words * _WORD_BYTES / TASK_BYTES))
    start = np.eye(width) if width == items.size else np.linalg.qr(np.random.default_rng(0).standard_normal((items.size, width)))[0]
    shared = spark.sparkContext.broadcast((items, start.astype(np.float32)))

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum over passages a of a'(aW), and of a'a."""
        items, start = shared.value
        weighted = _weighted(items, start)
        total, energy = np.zeros(start.shape, np.float32), 0.0
        for rows in passages_of(items, texts_of(batches)):
            for at in range(0, len(rows), _NEAR_PASSAGES):
                near = rows[at : at + _NEAR_PASSAGES]
                words, a = _counts(near, items.size)
                # As in _energy, from the counts; 1 for empty passages.
                inside = a**2 @ items.idf[words] ** 2
                whole = inside + (near == items.size).sum(1) * items.other**2
                whole[whole == 0] = 1
                energy += float((inside / whole).sum())
                a /= np.sqrt(whole)[:, None].astype(np.float32)
                total[words] += a.T @ (a @ weighted[words])
        total *= items.idf[: items.size, None]
        used = np.unique(np.flatnonzero(total.any(1)) // _BLOCK_ROWS).tolist()
        yield _blocks({k: total[k * _BLOCK_ROWS : (k + 1) * _BLOCK_ROWS] for k in used}, {k: energy for k in used[:1]})

    schema = "block int, m binary, energy double"
    with small_batches(spark):
        added = docs.coalesce(tasks).mapInArrow(push, schema).repartition("block").mapInArrow(_add_blocks, schema).toArrow()
    pushed, energy = np.zeros(start.shape), sum(added.column("energy").to_pylist())
    for block, m in zip(added.column("block").to_pylist(), added.column("m"), strict=True):
        pushed[block * _BLOCK_ROWS : (block + 1) * _BLOCK_ROWS] = np.frombuffer(m.as_buffer(), np.float32).reshape(-1, width)
    share = ITEM_WEIGHT * max(1.0, energy) / len(items.pieces)
    for _, y in _units(items):
        pushed += share * (y.T @ (y @ start))
    inner = start.T @ pushed
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    sure = values > _NOISE * values[-1]
    items.basis = np.linalg.svd(pushed @ (vectors[:, sure] / np.sqrt(values[sure])), full_matrices=False)[0][:, :rank].astype(np.float32)
    items.latent = np.concatenate([y @ items.basis for _, y in _units(items)])
    items.lost = np.sqrt(np.maximum(0, 1 - (items.latent**2).sum(1)))
    items.pushed = _weighted(items, items.basis)
    most = np.zeros(items.size, np.float32)
    for _, y in _units(items):
        most = np.maximum(most, y.max(0))
    items.most = np.append(most * items.idf[: items.size], [0, 0]).astype(np.float32)


def holds_phrase(text: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the phrase's words stand in the text one after another."""
    at = np.flatnonzero(text[: max(0, len(text) - len(phrase) + 1)] == phrase[0])
    return any(np.array_equal(text[k : k + len(phrase)], phrase) for k in at.tolist())


def _masks(item: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def common_subsequence(text: np.ndarray, item: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    masks = _masks(item) if masks is None else masks
    full = (1 << len(item)) - 1
    state = full
    for m in filter(None, map(masks.get, text.tolist())):
        hit = state & m
        state = (state + hit | state - hit) & full
    return len(item) - state.bit_count()


def candidates(items: Items, rows: np.ndarray, min_cosine: float) -> Iterator[tuple[int, int, float]]:
    """(passage, piece, latent cosine) that the latent space can't rule out."""
    inside, whole = _energy(items, rows)
    # No cosine is above the sum of each word's weight times its largest in any piece.
    live = np.flatnonzero((items.most[rows].sum(1) >= (min_cosine - 1e-4) * np.sqrt(whole)) & (inside > 0))
    if not len(live):
        return
    z = _project(rows[live], items.pushed) / np.sqrt(whole[live])[:, None]
    lost = np.sqrt(np.maximum(0, inside[live] / whole[live] - (z**2).sum(1)))
    cosine = z @ items.latent.T
    for p, k in zip(*np.nonzero(cosine + lost[:, None] * items.lost[None, :] >= min_cosine - 1e-4), strict=True):
        yield int(live[p]), int(k), float(cosine[p, k])


def latent_cosine(items: Items, row: np.ndarray, item: int) -> float:
    """The largest latent cosine of a passage with a piece of the item; 0 without any of the items' words."""
    inside, whole = _energy(items, row)
    if inside[0] <= 0:
        return 0.0
    mine = [k for k, (i, _) in enumerate(items.pieces) if i == item]
    return float((items.latent[mine] @ (_project(row, items.pushed)[0] / np.sqrt(whole[0]))).max())


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, min_cosine: float = 0.3, strict: float = 0.8, loose: float = 0.6, answer_share: float = 0.6, rank: int | None = None) -> DataFrame:
    """One row per document and item that it holds: id, item_id, cosine, lcs, answer, start, stop (words)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    schema = "id long, item_id long, cosine double, lcs double, answer double, start long, stop long"
    found = rows.sparkSession.createDataFrame([], schema)
    size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.coalesce(F.sum(F.octet_length("answer")), F.lit(0))).first()
    blocks = max(math.ceil(size[0] / BLOCK_ITEMS), math.ceil(size[1] / BLOCK_BYTES))
    for b in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text")
        items = read_items([tuple(r) for r in part.collect()])
        if items.ids:
            hits = _search(rows, items, min_cosine, strict, loose, answer_share, rank, schema)
            found = hits if b == 0 else found.unionByName(hits)
    return found


def _search(rows: DataFrame, items: Items, min_cosine: float, strict: float, loose: float, answer_share: float, rank: int | None, schema: str) -> DataFrame:
    frequencies, documents, words = document_frequencies(rows, items)
    weigh(items, frequencies, documents)
    list_words(items, min(strict, loose))
    fit_basis(rows, items, words, rank)
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        masks = [(_masks(w), _masks(a)) for w, a in zip(items.words, items.answers, strict=True)]

        def check(ids: np.ndarray, at: int, item: int) -> tuple[float, float, int, int] | None:
            """The subsequences' shares and the span, if it holds the item."""
            words, answer = items.words[item], items.answers[item]
            start, stop = max(0, at - len(words)), min(len(ids), at + PASSAGE + len(words))
            span = ids[start:stop]
            if is_phrase(words):
                return (1.0, 1.0, start, stop) if holds_phrase(span, words) else None
            lcs = common_subsequence(span, words, masks[item][0]) / len(words)
            if lcs < min(strict, loose):
                return None
            share = common_subsequence(span, answer, masks[item][1]) / len(answer)
            return (lcs, share, start, stop) if lcs >= strict or lcs >= loose and share >= answer_share else None

        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            held: list[tuple[int, np.ndarray]] = []

            def flush():
                parts = [_rows_of(ids) for _, ids in held]
                lows = np.cumsum([0] + [len(p) for p in parts])
                table = np.concatenate(parts)
                tried = set()
                for p, piece, cosine in candidates(items, table, min_cosine):
                    d = int(np.searchsorted(lows, p, "right")) - 1
                    number, ids = held[d]
                    at, item = (p - int(lows[d])) * STRIDE, items.pieces[piece][0]
                    if (number, item, at) in tried:
                        continue
                    tried.add((number, item, at))
                    if hit := check(ids, at, item):
                        keep(number, item, cosine, hit)
                for d, p, item in overlaps(items, [ids for _, ids in held]):
                    number, ids = held[d]
                    if (number, item, p * STRIDE) not in tried and (hit := check(ids, p * STRIDE, item)):
                        row = int(lows[d]) + p
                        keep(number, item, latent_cosine(items, table[row : row + 1], item), hit)
                held.clear()

            def keep(number: int, item: int, cosine: float, hit: tuple[float, float, int, int]):
                lcs, answer, start, stop = hit
                best[number, item] = max(best.get((number, item), (0.0,)), (lcs, answer, cosine, -start, -stop))

            words = 0
            for number, text in enumerate(texts_of([batch])):
                held.append((number, items.read(text)))
                words += len(held[-1][1])
                if words >= _SLICE_WORDS:
                    flush()
                    words = 0
            if held:
                flush()
            keys = sorted(best)
            ids = batch.column(0).to_pylist()
            values = [best[k] for k in keys]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([ids[d] for d, _ in keys], pa.int64()),
                "item_id": pa.array([items.ids[k] for _, k in keys], pa.int64()),
                "cosine": pa.array([v[2] for v in values], pa.float64()),
                "lcs": pa.array([v[0] for v in values], pa.float64()),
                "answer": pa.array([v[1] for v in values], pa.float64()),
                "start": pa.array([-v[3] for v in values], pa.int64()),
                "stop": pa.array([-v[4] for v in values], pa.int64()),
            })

    return rows.mapInArrow(scan, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with the input's columns.

    Rows are matched by a hash of id and text, so those without an id or with a repeated one are told apart.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    hits = find_items(docs.select(key.alias("_key"), F.col(text_col)), benchmark, id_col="_key", text_col=text_col, **options)
    with small_batches(docs.sparkSession):
        leaks = materialise(hits.select("id").distinct(), "leaks")
    return docs.join(leaks, key == leaks["id"], "left_anti").select(*[docs[c] for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    found = find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")
