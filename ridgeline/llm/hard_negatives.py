"""Hard negatives by maximum inner product with coordinate pruning, in the manner of LEMP.

Queries (anchors) are written in blocks of bounded size; every task reads its own rows of
the table once, in chunks, and meets the blocks one by one. A chunk sorts its rows by
length into buckets, and each bucket holds its unit vectors as one sorted list per
coordinate. An anchor that still needs scores of ``t`` or more needs a cosine of
``t / (|anchor| |longest of the bucket|)`` there: above 1 it skips the bucket and all
shorter ones. Otherwise the anchor's largest coordinates (the focus) bound the angle, and
so the range of values that a row can have in each of them; the shortest range in the
sorted lists gives the candidates, the other ranges are intersected with it, and only what
is left gets its exact integer score. ``t`` rises with what has been found in the chunk.

Two searches run this way: the anchors' positives, then for each anchor and positive the
negatives in a window of scores. Each chunk returns its own first ones, and window ranks
merge them. The rows never move after they are dealt out, and copies of one vector are
dealt to all tasks. Work is queries times rows, as the contract has it, less what is pruned.

Components are ``floor(256 x)`` and scores exact integers. Rows with a null id, label or
vector, or a null or non-finite component, take no part. Shorter vectors count as filled
up with zeros. Rows alike in id, label and vector count once; rows that repeat an id with
another label or vector are rows of their own, but never partners of an anchor of that
id. Anchors without a positive, and positives without a negative, have no row. Components
of 2^26 and more (of x: 262144) are multiplied as Python integers; scores beyond 64 bits
raise an error. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import blobs
from ridgeline.storage import materialise, scratch

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Anchors of a block, rows of a bucket, values of a chunk, focus coordinates.
BLOCK, BUCKET, CHUNK, FOCUS = 2048, 1024, 1 << 22, 6
#: Room for rounding in cosines and angles.
_SLACK = 1e-9
_EXACT = 1 << 26


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, q: rows that take part, once each, with whole components."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).filter(F.coalesce(finite, F.lit(False)))

    # Whole numbers as doubles, so that no component overflows; from 2^53 on they are whole.
    def whole(x: Column) -> Column:
        y = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vec_col, whole).alias("q")).dropDuplicates()


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products: doubles hold sums below 2^53, 64-bit words below 2^63."""
    top = (np.abs(rows).max(initial=0), np.abs(q).max(initial=0))
    bound = float(top[0]) * float(top[1]) * max(len(q), 1)
    if bound < 2.0**53:
        return (rows @ q).astype(np.int64)
    if max(top) < _EXACT:
        return rows.astype(np.int64) @ q.astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for r in rows.tolist()]
    return np.array(exact, np.int64)


class Bucket:
    """Rows of like lengths, with a sorted list of unit values for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, norms: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.longest, self.shortest = float(norms.max()), float(norms.min())
        self.unit = np.ascontiguousarray((rows / np.where(norms > 0, norms, 1)[:, None]).T)
        self.order = np.argsort(self.unit, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=1)

    def cosine(self, least: float, norm: float) -> float:
        """What any row with a score of ``least`` needs as its cosine."""
        length = norm * (self.longest if least > 0 else self.shortest)
        if not np.isfinite(length):
            return -1.0
        return least / length - _SLACK if length > 0 else (-1.0 if least <= 0 else 2.0)

    def candidates(self, focus: np.ndarray, angles: np.ndarray, cosine: float) -> np.ndarray | None:
        """Positions whose focus coordinates all lie in their ranges; None stands for all."""
        if cosine <= -1 or not len(focus):
            return None
        wide = np.arccos(min(cosine, 1.0))
        low, high = np.cos(np.minimum(angles + wide, np.pi)) - _SLACK, np.cos(np.maximum(angles - wide, 0)) + _SLACK
        start = [self.sorted[f].searchsorted(v, "left") for f, v in zip(focus, low, strict=True)]
        end = [self.sorted[f].searchsorted(v, "right") for f, v in zip(focus, high, strict=True)]
        k = min(range(len(focus)), key=lambda i: end[i] - start[i])
        found = self.order[focus[k], start[k] : end[k]]
        for i, f in enumerate(focus):
            if i != k and end[i] - start[i] < len(self.ids):
                value = self.unit[f, found]
                found = found[(value >= low[i]) & (value <= high[i])]
        return found


def _buckets(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, size: int) -> list[Bucket]:
    norms = np.sqrt((rows * rows).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    return [Bucket(ids[at], labels[at], rows[at], norms[at]) for at in (order[i : i + size] for i in range(0, len(order), size))]


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores))[:n]
    return scores[at], ids[at]


def _search(buckets: list[Bucket], q: np.ndarray, least: Callable[[], int | None], take: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Offers ``take`` the exact scores of all rows that can reach what ``least`` says just now (None: nothing can)."""
    norm = float(np.sqrt((q * q).sum()))
    unit = q / norm if norm > 0 else q
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS] if norm > 0 and np.isfinite(norm) else np.zeros(0, np.int64)
    angles = np.arccos(np.clip(unit[focus], -1, 1))
    for b in buckets:
        t = least()
        if t is None:
            return
        cosine = b.cosine(t, norm)
        if cosine > 1:  # nor can shorter rows
            return
        at = b.candidates(focus, angles, cosine)
        rows, ids, labels = (b.rows, b.ids, b.labels) if at is None else (b.rows[at], b.ids[at], b.labels[at])
        if len(ids):
            take(_scores(rows, q), ids, labels)


def _positives(buckets: list[Bucket], block: dict, k: int) -> Iterator[tuple]:
    for key, id_, label, q in zip(block["key"], block["id"], block["label"], block["q"], strict=True):
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def least() -> int:
            return int(best[0][-1]) if len(best[0]) == k else -(1 << 62)  # noqa: B023

        def take(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
            good = (labels == label) & (ids != id_) & (scores >= least())  # noqa: B023
            if good.any():
                best[:] = _first(np.concatenate([best[0], scores[good]]), np.concatenate([best[1], ids[good]]), k)  # noqa: B023

        _search(buckets, q, least, take)
        yield from ((key, 0, s, i) for s, i in zip(best[0].tolist(), best[1].tolist(), strict=True))


def _negatives(buckets: list[Bucket], block: dict, k: int) -> Iterator[tuple]:
    for key, id_, label, q, positive in zip(block["key"], block["id"], block["label"], block["q"], block["positive"], strict=True):
        windows = [(-(-LOW * int(p) // 100), HIGH * int(p) // 100) for p in positive]
        open_ = [j for j, (low, high) in enumerate(windows) if low <= high]
        best = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in windows]
        least_of = [low for low, _ in windows]

        def least() -> int | None:
            return min((least_of[j] for j in open_), default=None)  # noqa: B023

        def take(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
            good = (labels != label) & (ids != id_) & (scores >= least())  # noqa: B023
            scores, ids = scores[good], ids[good]
            for j in open_ if len(ids) else ():  # noqa: B023
                fits = (scores >= least_of[j]) & (scores <= windows[j][1])  # noqa: B023
                if fits.any():
                    best[j][:] = _first(np.concatenate([best[j][0], scores[fits]]), np.concatenate([best[j][1], ids[fits]]), k)  # noqa: B023
                    if len(best[j][0]) == k:  # noqa: B023
                        least_of[j] = int(best[j][0][-1])  # noqa: B023

        _search(buckets, q, least, take)
        for j in open_:
            yield from ((key, j, s, i) for s, i in zip(best[j][0].tolist(), best[j][1].tolist(), strict=True))


def _written(folder: str, dims: int, size: int):
    """Writes anchors in blocks and tells the blocks' names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                name, data = blobs.fresh_name("anchors", ".npz"), io.BytesIO()
                arrays = {c: table.column(c).to_numpy() for c in ("key", "id", "label")} | {"q": _matrix(table.column("q"), dims)}
                if "positive" in table.schema.names:
                    sizes = table.column("positive").value_lengths().to_numpy()
                    arrays |= {"positive": table.column("positive").flatten().to_numpy(), "sizes": sizes}
                np.savez(data, **arrays)
                with blobs.create(folder, name) as out:
                    out.write(data.getbuffer())
                yield pa.RecordBatch.from_pydict({"name": [name]})

    return write


def _blocks(anchors: DataFrame, dims: int, name: str) -> tuple[str, list[str]]:
    folder = scratch(anchors.sparkSession, name)
    whole = anchors.repartition(anchors.count() // BLOCK + 1)
    made = materialise(whole.mapInArrow(_written(folder, dims, BLOCK), "name string"), name + "-names")
    return folder, sorted(r.name for r in made.toLocalIterator())


def _loaded(folder: str, name: str) -> dict:
    with blobs.open_at(folder, name) as f, np.load(io.BytesIO(f.read())) as x:
        block = {k: x[k] for k in x.files}
    if "sizes" in block:
        block["positive"] = np.split(block["positive"], np.cumsum(block.pop("sizes"))[:-1])
    return block


_FOUND = "key long, j int, score long, found long"


def _scan(rows: DataFrame, dims: int, blocks: tuple[str, list[str]], search: Callable, k: int) -> DataFrame:
    """The first ``k`` of each chunk of rows for each query of the blocks."""
    (folder, names), size, chunk = blocks, BUCKET, CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "label"))
            buckets = _buckets(ids, labels, np.concatenate([_matrix(b.column("q"), dims) for b in held]), size)
            for name in names:
                got = list(search(buckets, _loaded(folder, name), k))
                for i in range(0, len(got), 50_000):
                    part = list(zip(*got[i : i + 50_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "j", "score", "found"])

        held, values = [], 0
        for batch in batches:
            held.append(batch)
            values += batch.num_rows * max(dims, 1)
            if values >= chunk:
                yield from answer(held)
                held, values = [], 0
        if values:
            yield from answer(held)

    return rows.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "j").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label and q, as ``prepared`` gives them.
    """
    rows = materialise(rows, "vectors")
    dims = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0)).alias("n")).first().n
    # A number of its own for each anchor, as ids may repeat.
    anchors = materialise(rows.filter(is_anchor).withColumn("key", F.monotonically_increasing_id()), "anchors")
    found = _ranked(_scan(rows, dims, _blocks(anchors, dims, "anchor-blocks"), _positives, positives), positives)
    paired = materialise(found.select("key", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("r")), "positives")
    lists = paired.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "positive_score"))).getField("positive_score").alias("positive"))
    mined = _ranked(_scan(rows, dims, _blocks(materialise(anchors.join(lists, "key"), "pairs"), dims, "pair-blocks"), _negatives, negatives), negatives)
    pairs = paired.withColumn("j", F.col("r") - 1).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    out = mined.join(pairs, ["key", "j"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row against all others; every seventh row's label is moved on first."""
    rows = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""
