"""Near-duplicate groups by bottom-k sketches from one hash function.

1. A text's shingles are hashed once; its sketch is the ``SKETCH`` smallest hashes.
   Texts with equal shingle sets become one class, named by its smallest id.
2. A pair at the threshold has at least ``least_overlap`` retained values in common, so
   it meets in an inverted list of one of each class's rarest values (as many as the
   sketch may lack, and one more). Values that no other class retains have no list, and
   values that very many retain are listed only by classes that have few others.
3. In a list the common retained values of its classes are counted (as a product of
   incidence matrices). A pair goes on if they are enough and if the sketch of the union
   (the smallest hashes of both) gives an estimate within ``SLACK`` standard errors of
   the threshold. A list leaves the classes that have such a partner, never its pairs.
4. Full shingle sets of those classes are made from the texts and pairs are confirmed
   by exact Jaccard similarity. What leaves a task is a forest: fewer links than classes.
5. Connected components of the links.

Steps 3 and 4 run twice. The first time a class is only in its longest list; lists
longer than ``BLOCK`` are dealt to blocks, which share about ``HUBS`` of the list's
classes, so that the blocks of a group of copies are joined through them. The second
time come all pairs that have not met yet: in a long list, the classes outside its
largest component against all of the list, block by block; in the other lists, classes
of different longest lists. Pairs that links already join need no second look, and any
pair is looked at in the longest list alone that both are in. So a
group of copies costs in proportion to its size, but for members that link to few others:
those are compared with the whole group. No task holds more than two blocks.

The lists rest on hashes: a pair at the threshold fails ``least_overlap`` or the estimate
with a chance of about 1e-7 (sets of at most ``SKETCH`` shingles: never).

Null texts and texts without words have an empty set and link to nothing. Ids are
meant to be unique; rows that share one are linked through it. Rows without an id take
the component of their class, null where no member has an id. An empty table gives an
empty result. Other columns are ignored. A task needs memory of some 60 times its
longest text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.batches import in_slices, small_batches
from ridgeline.llm.bitmaps import bitmap, has
from ridgeline.llm.native import mark_members, member_filter
from ridgeline.llm.shingles import shingle_sets, slices
from ridgeline.operators.graph import connected_components
from ridgeline.storage import bucketed, in_groups, materialise, materialise_with

SKETCH, SLACK, BLOCK, HUBS = 64, 6, 1024, 64
_PAD = np.uint64(2**64 - 1)
_BULK = 1 << 12
#: Groups of up to this many classes are compared together with others.
_SMALL = 24
_COLUMNS = 1024
#: Shingles for which a set counts as one more in a block.
_LARGE = 4096


def least_overlap(size: int, threshold: float) -> int:
    """Retained values that a set of ``size`` shingles has in common with any other at the threshold."""
    exact = max(1, math.ceil(threshold * min(size, SKETCH) - 1e-9))
    if size <= threshold * SKETCH:
        return exact  # partners are no larger than a sketch
    return max(1, min(exact, math.floor(threshold * SKETCH - SLACK * math.sqrt(SKETCH * threshold * (1 - threshold)))))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
    for a, b in slices(texts):
        yield ids[a:b], shingle_sets(texts[a:b], size)


def _set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, text) to (id, n, set_hash, sketch); set_hash is null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for ids, sets in _sets(batch, size):
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids, pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_hash": pa.array([_set_hash(s) if len(s) else None for s in sets], pa.binary()),
                    "sketch": pa.array([s[:SKETCH].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                })

    return docs.mapInArrow(sign, "id long, n long, set_hash binary, sketch array<long>")


def _short_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).flatten().to_numpy()
        yield pa.RecordBatch.from_pydict({"key": pa.array((values & 0xFFFFFFFF).astype(np.uint32).view(np.int32))})


def shared_values(classes: DataFrame) -> DataFrame:
    """Rows (rep, n, sketch) to (rep, n, key): the retained values that another class may have too."""
    # A short hash is enough to tell values that can be left out.
    twice = classes.select("sketch").mapInArrow(_short_values, "key int").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = classes.sparkSession.sparkContext.broadcast(bitmap(twice.select(F.col("key").cast("long").alias("key")), "key"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = batch.column(2)
            values = sketch.flatten().to_numpy()
            hit = has(shared.value, values.view(np.uint64))
            row = np.repeat(np.arange(len(batch)), sketch.value_lengths().to_numpy())[hit]
            yield pa.RecordBatch.from_pydict({"rep": batch.column(0).take(pa.array(row)), "n": batch.column(1).take(pa.array(row)), "key": pa.array(values[hit])})

    return classes.select("rep", "n", "sketch").mapInArrow(pick, "rep long, n long, key long")


def rare_values(values: DataFrame, threshold: float) -> DataFrame:
    """Rows (rep, n, key) to (rep, n, keys): of each class's shared values the rarest, as many as the lists need."""
    times = values.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    found = values.join(times, "key").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "key"))).alias("values"))
    size = F.least("n", F.lit(SKETCH)).cast("int")
    least = F.element_at(F.array(*[F.lit(least_overlap(s, threshold)) for s in range(1, SKETCH + 1)]), size)
    # The values without a list are the rarest of all.
    take = size - least + 1 - (size - F.size("values"))
    return found.withColumn("take", take).filter("take > 0").select("rep", "n", F.slice("values", 1, F.col("take")).getField("key").alias("keys"))


def ranked_lists(rare: DataFrame) -> DataFrame:
    """Rows (rep, n, keys) to (rep, n, lists): the lists of each class, the longest first; of lists with the same members one."""
    keyed = rare.select(F.explode("keys").alias("key"), "rep", "n")
    lists = keyed.groupBy("key").agg(F.count("*").alias("listed"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(xxhash64(rep, 1))").alias("x")).filter("listed > 1")
    lists = lists.groupBy("listed", "s", "x").agg(F.min("key").alias("key")).select("key", "listed")
    ranked = keyed.join(lists, "key").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("listed", "key")), asc=False).alias("lists"))
    return ranked.select("rep", "n", F.col("lists").getField("key").alias("lists"))


def _block(blocks) -> Column:
    return F.pmod(F.xxhash64("rep"), blocks).cast("int")


def _weight() -> Column:
    """A class's share of a block: one, and more for a set so large that a block would need too much memory."""
    return F.expr(f"1 + n div {_LARGE}")


def _none() -> Column:
    return F.array().cast("array<long>")


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / BLOCK).cast("int")


def _first_tasks(tops: DataFrame) -> DataFrame:
    """Rows (list, rep, n, blocks, size) to (task, side, rep, part, label, above); side 2 is compared with itself."""
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("list", "rep"), F.col("blocks") * BLOCK) < HUBS)
    block = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block(F.col("blocks")))))
    rows = tops.filter("size > 1").withColumn("block", block)
    return rows.select(F.xxhash64("list", "block").alias("task"), F.lit(2).alias("side"), "rep", F.col("rep").alias("part"), F.col("rep").alias("label"), _none().alias("above"))


def _other_tasks(rows: DataFrame) -> DataFrame:
    """Rows (list, rep, n, part, label, above) to tasks that bring together all of a list that differ in part and label."""
    parts = rows.groupBy("list", "part").agg(F.sum(_weight()).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    lists = parts.groupBy("list").agg(
        F.sum("size").alias("total"), F.max("size").alias("largest"), F.max_by("part", F.struct("size", "part")).alias("main"),
        F.count("*").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"),
    ).filter("parts > 1 AND low < high").drop("parts", "low", "high")
    rows = rows.join(lists, "list").withColumns({"rest": _blocks(F.col("total") - F.col("largest")), "all": _blocks(F.col("total"))})
    short = rows.filter("all = 1").select(F.xxhash64("list").alias("task"), F.lit(2).alias("side"), "rep", "part", "label", "above")
    long = rows.filter("all > 1")

    def task(side: int, i: Column, j: Column) -> Column:
        return F.struct(F.xxhash64("list", i, j).alias("task"), F.lit(side).alias("side"))

    as_rest = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: task(0, _block(F.col("rest")), j))
    as_any = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: task(1, i, _block(F.col("all"))))
    dealt = F.when(F.col("part") == F.col("main"), as_any).otherwise(F.concat(as_rest, as_any))
    return short.unionByName(long.withColumn("t", F.explode(dealt)).select("t.task", "t.side", "rep", "part", "label", "above"))


class Group:
    """Rows of one task."""

    def __init__(self, task: int) -> None:
        self.task = task
        self.side: list[int] = []
        self.rep: list[int] = []
        self.part: list[int] = []
        self.label: list[int] = []
        self.above: list[list[int]] = []
        self.n: list[int] = []
        self.values: list[np.ndarray] = []

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        side = np.array(self.side)
        both = np.flatnonzero(side == 2)
        return (both, both) if len(both) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs to compare; each once where a side is compared with itself."""
        part, label = np.array(self.part), np.array(self.label)
        out = (part[a][:, None] != part[b][None, :]) & (label[a][:, None] != label[b][None, :])
        out = np.triu(out, 1) if a is b else out
        # A pair is looked at in the longest of the lists that both are in.
        if len(self.rep) <= _SMALL:
            lists = [set(x) for x in self.above]
            for x, y in zip(*np.nonzero(out), strict=True):
                out[x, y] = lists[a[x]].isdisjoint(lists[b[y]])
        elif any(self.above):
            lists = [np.array(x, np.int64) for x in self.above]
            out &= common_counts([lists[k] for k in a], [lists[k] for k in b]) == 0
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left = [self.values[k] for k in a]
        return common_counts(left, left if a is b else [self.values[k] for k in b])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Columns task, side, rep, part, label, above, n, values, sorted by task; a task may go over batches."""
    group = None
    for batch in batches:
        for task, side, rep, part, label, above, n, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group is None or task != group.task:
                if group is not None:
                    yield group
                group = Group(task)
            group.side.append(side)
            group.rep.append(rep)
            group.part.append(part)
            group.label.append(label)
            group.above.append(above)
            group.n.append(n)
            group.values.append(np.frombuffer(values, np.uint64))
    if group is not None:
        yield group


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``a`` and each of ``b`` have in common: inverted lists as a product of matrices."""
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    values = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    if a is b:
        found, times = np.unique(values[0], return_counts=True)
        shared = found[times > 1]
    sides = []
    for r, v in zip(rows, values, strict=True):
        at = np.searchsorted(shared, v)
        have = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == v) if len(shared) else np.zeros(0, int)
        order = have[np.argsort(at[have], kind="stable")]
        sides.append((r[order], at[order]))
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(shared), _COLUMNS):
        dense = []
        for (r, at), many in zip(sides, (len(a), len(b)), strict=True):
            start, stop = np.searchsorted(at, (low, low + _COLUMNS))
            d = np.zeros((many, min(_COLUMNS, len(shared) - low)), np.float32)
            d[r[start:stop], at[start:stop] - low] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def estimates(sketches: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (i, j) the sketches of their unions can't rule out."""
    a, b = sketches[i], sketches[j]
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    rank = np.cumsum(np.concatenate([both[:, :1] != _PAD, ~same & (both[:, 1:] != _PAD)], 1), axis=1)
    total = np.minimum(rank[:, -1], SKETCH)
    common = (same & (rank[:, 1:] <= SKETCH)).sum(1)
    whole = np.maximum(sizes[i], sizes[j]) <= SKETCH
    slack = np.where(whole & (rank[:, -1] <= SKETCH), 1e-9, SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(total, 1)))
    return (common / np.maximum(total, 1) >= threshold - slack) & (common > 0)


def _sketch_table(groups: list[Group]) -> np.ndarray:
    values = [v for g in groups for v in g.values]
    table = np.full((len(values), SKETCH), _PAD)
    size = np.array([len(v) for v in values])
    table[np.arange(SKETCH)[None, :] < size[:, None]] = np.concatenate(values)
    return table


def flagged(groups: list[Group], threshold: float) -> list[tuple[Group, int]]:
    """The classes that have a partner in their group, as groups and row numbers."""
    table, sizes = _sketch_table(groups), np.array([n for g in groups for n in g.n], np.int64)
    least = np.array([least_overlap(s, threshold) for s in range(SKETCH + 1)])[np.minimum(sizes, SKETCH)]
    lows = np.cumsum([0] + [len(g.rep) for g in groups])
    first, second = [], []
    for g, low in zip(groups, lows, strict=False):
        a, b = g.sides()
        if not len(a) or not len(b):
            continue
        wanted = g.apart(a, b)
        if len(g.rep) > _SMALL:
            wanted &= g.common(a, b) >= np.maximum(least[low + a][:, None], least[low + b][None, :])
        x, y = np.nonzero(wanted)
        first.append(a[x] + low)
        second.append(b[y] + low)
    if not first:
        return []
    i, j = np.concatenate(first), np.concatenate(second)
    live = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[live], j[live]
    found = np.zeros(len(table), bool)
    for at in range(0, len(i), _BULK):
        x, y = i[at : at + _BULK], j[at : at + _BULK]
        fresh = ~(found[x] & found[y])
        x, y = x[fresh], y[fresh]
        good = estimates(table, sizes, x, y, threshold)
        found[x[good]] = found[y[good]] = True
    rows = np.flatnonzero(found)
    of = np.searchsorted(lows, rows, "right") - 1
    return [(groups[g], row) for g, row in zip(of.tolist(), (rows - lows[of]).tolist(), strict=True)]


def _links(group: Group, threshold: float) -> list[tuple[int, int]]:
    """A forest of confirmed links among a group's classes."""
    a, b = group.sides()
    if not len(a) or not len(b):
        return []
    common, n = group.common(a, b), np.array(group.n)
    union = n[a][:, None] + n[b][None, :] - common
    above = {r: r for r in group.rep}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    found = []
    for x, y in zip(*np.nonzero((common * 10_000 >= round(threshold * 10_000) * union) & group.apart(a, b)), strict=True):
        s, t = group.rep[a[x]], group.rep[b[y]]
        if (i := root(s)) != (j := root(t)):
            above[i] = j
            found.append((s, t))
    return found


_TASK = "task long, side int, rep long, part long, label long, above array<long>, n long"
_KINDS = {"side": pa.int32(), "above": pa.list_(pa.int64())}


def _scan_partners(threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(groups: list[Group]) -> pa.RecordBatch:
            rows = flagged(groups, threshold)
            named = {"task": [g.task for g, _ in rows]} | {k: [getattr(g, k)[r] for g, r in rows] for k in ("side", "rep", "part", "label", "above", "n")}
            return pa.RecordBatch.from_pydict({k: pa.array(v, _KINDS.get(k, pa.int64())) for k, v in named.items()})

        held, pairs = [], 0
        for group in _groups(batches):
            if len(group.rep) > 1:
                held.append(group)
                pairs += len(group.rep) ** 2 // 2
            if pairs >= _BULK or len(held) >= 2000:
                yield flush(held)
                held, pairs = [], 0
        if held:
            yield flush(held)

    return scan


def _scan_links(threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if found := _links(group, threshold):
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return scan


def _link(tasks: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Confirmed links (a, b) between the classes of each task; ``sets`` lies in buckets, so only tasks move to them."""
    wide, seen = materialise_with(tasks, "near-tasks", rows=F.count(F.lit(1)))
    sides = [F.col(c) for c in ("task", "side", "rep", "part", "label", "above")]
    sketched = in_groups(wide.join(sets.select("rep", "n", "sketch"), "rep").select(*sides, "n", "sketch"), "task", seen["rows"] * 8 * SKETCH)
    partners, seen = materialise_with(sketched.mapInArrow(_scan_partners(threshold), _TASK), "near-partners", shingles=F.sum("n"))
    full = partners.join(sets.select("rep", "set"), "rep").select(*sides, "n", "set")
    return materialise(in_groups(full, "task", (seen["shingles"] or 0) * 8).mapInArrow(_scan_links(threshold), "a long, b long"), "near-links")


def _all_links(ranked: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    tops = ranked.select("rep", "n", F.col("lists")[0].alias("list"))
    sizes = tops.groupBy("list").agg(_blocks(F.sum(_weight())).alias("blocks"), F.count("*").alias("size"))
    tops = materialise(tops.join(sizes, "list"), "near-tops")
    first = _link(_first_tasks(tops), sets, threshold)
    labels = connected_components(first, "near-labels").select(F.col("id").alias("rep"), "component")
    named = materialise(tops.select("rep", "n", "list", "blocks").join(labels, "rep", "left").select("rep", "n", "list", "blocks", F.coalesce("component", "rep").alias("label")), "near-named")
    # In a list of one block all pairs have met.
    within = named.filter("blocks > 1").select(F.xxhash64(F.lit(1), "list").alias("list"), "rep", "n", F.col("label").alias("part"), "label", _none().alias("above"))
    placed = ranked.select("rep", "lists", F.posexplode("lists").alias("place", "at")).join(named.select("rep", "n", "label"), "rep")
    across = placed.select(F.xxhash64(F.lit(2), "at").alias("list"), "rep", "n", F.col("lists")[0].alias("part"), "label", F.slice("lists", F.lit(1), F.col("place")).alias("above"))
    return first.unionByName(_link(_other_tasks(within.unionByName(across)), sets, threshold))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        signed = materialise(signatures(rows, shingle), "near-signatures")
    classes = materialise(signed.filter("n > 0").groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-classes")
    named = classes.filter("rep IS NOT NULL")
    values = materialise(shared_values(named), "near-values")
    ranked, seen = materialise_with(ranked_lists(rare_values(values, threshold)), "near-lists", shingles=F.sum("n"))
    wanted = ranked.select("rep")
    marked = mark_members(rows, F.xxhash64("id"), member_filter(wanted.select(F.xxhash64("rep").alias("key")), "key"), "wanted").filter("wanted").select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for ids, found in _sets(batch, shingle):
                yield pa.RecordBatch.from_pydict({"rep": pa.array(ids, pa.int64()), "set_hash": pa.array([_set_hash(s) for s in found], pa.binary()), "set": pa.array([s.tobytes() for s in found], pa.binary())})

    full = marked.mapInArrow(sets, "rep long, set_hash binary, set binary")
    # Rows that share an id may have other sets than the class it names; alike rows are taken once.
    full = full.join(named.select("rep", "set_hash", "n").join(wanted, "rep", "left_semi"), ["rep", "set_hash"]).dropDuplicates(["rep", "set_hash"])
    full = full.select("rep", "n", F.substring("set", 1, 8 * SKETCH).alias("sketch"), "set")
    with bucketed(full, "near_sets", "rep", (seen["shingles"] or 0) * 8) as placed:
        links = _all_links(ranked, placed, threshold)
    labels = connected_components(links, "near-components")
    found = classes.select("set_hash", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    # Empty sets get a key each, so that they spread.
    key = F.coalesce("set_hash", F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    joined = signed.select("id", "n", key.alias("set_hash")).join(found, "set_hash", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the input's columns: one of each group, that with the smallest id (null last).

    Documents are told apart by id and text, so that those without an id, or with a
    repeated one, are linked and judged each on its own; of rows alike in both one stays.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(key.alias("_key"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = near_duplicates(rows, threshold, id_col="_key", text_col="_text").groupBy(F.col("id").alias("_key")).agg(F.min("component_id").alias("component"))
    judged = materialise(rows.groupBy("_key").agg(F.min("_id").alias("_id"), F.count("*").alias("rows")).join(found, "_key"), "near-judged")
    first = judged.groupBy("component").agg(F.min(F.struct(F.isnull("_id"), "_id", "_key")).getField("_key").alias("_key")).select("_key", F.lit(True).alias("_first"))
    # The others are many; only documents that go or are repeated are looked up.
    special = materialise(judged.join(first, "_key", "left").select("_key", F.coalesce("_first", F.lit(False)).alias("_first"), "rows").filter("NOT _first OR rows > 1"), "near-special")
    whole = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row"))
    marked = mark_members(whole, F.col("_key"), member_filter(special, "_key"), "_marked")
    plain = marked.filter("NOT _marked").select("_row")
    looked = marked.filter("_marked").join(special, "_key", "left").filter("_first IS NULL OR _first")
    once, repeated = looked.filter("rows IS NULL").select("_row"), looked.filter("rows IS NOT NULL").dropDuplicates(["_key"]).select("_row")
    return plain.unionByName(once).unionByName(repeated).select("_row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates over all documents, at 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.85).withColumnRenamed("id", "doc_id")
