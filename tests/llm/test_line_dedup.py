"""Line dedup and its perfect hash against plain Python."""

import re

import numpy as np
import pytest

from ridgeline.llm import line_dedup as ld
from ridgeline.llm import perfect_hash as ph

SCHEMA = "doc_id long, text string, id string, lines long, gone string"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_docs=5, min_chars=40):
    holders = {}
    for n, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append((float("-inf") if d is None else d, n))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(h for h, _ in holders[key(x)]) != (float("-inf") if d is None else d) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


def documents():
    footer, accents = "All rights reserved by the publisher of this page" * 1, "Ça et là, ÉTÉ comme hiver, tout le monde s'en va"
    rows = [(i, f"own line {i} that nobody else has in the whole table\n  {footer.upper() if i % 2 else footer}\t\nshort\n{accents}\x0b") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "short"), (24, f"{footer}\n{footer}\n"), (24, f"x\n{footer}"), (5, "repeated id\n" + accents)]
    rows += [(None, footer), (None, f"{footer}\nnull ids"), *((i, "a line that only four documents of the table hold") for i in range(30, 34)), *((i, "é" * 39) for i in range(40, 46)), *((i, "é" * 40) for i in range(46, 52))]
    rows += [(60, "\n".join(f"line {i} of a very long text, long enough to be a key" for i in range(30_000))), *((i, "\n".join(f"LINE {i} of a very long text, long enough to be a key" for i in range(7, 1_000, 9))) for i in range(61, 66))]
    return rows + [(i, "one line of a great many documents, all of it the same") for i in range(100, 400)]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 20_000).astype(np.uint64), rng.permutation(20_000).astype(np.uint64)  # halves that repeat
    sizes, words = ph.build(a, b)
    slots = ph.Slots(sizes, words)
    assert sorted(slots.of(a, b).tolist()) == list(range(20_000))
    others = slots.of(a, b + np.uint64(10**9))
    assert others.max() < 20_000 and others.min() >= -1
    assert len(words) * 64 < 5 * 20_000
    none = ph.Slots(*ph.build(a[:0], b[:0]))
    assert none.of(a[:3], b[:3]).tolist() == [-1] * 3


def test_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "q", 1, "g") for r in rows], SCHEMA)
    assert sorted(map(tuple, ld.dedup_lines(df).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, ld.dedup_lines(df, min_docs=2, min_chars=5).collect()), key=str) == brute(rows, 2, 5)


def test_many_shards_that_do_not_stay(spark, monkeypatch):
    monkeypatch.setattr(ld, "RESIDENT", 1)
    monkeypatch.setattr(ld, "PROBES", 100)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = ld.build_index(df, min_chars=5, shard_keys=10)
    assert index.shards > 10
    assert sorted(map(tuple, ld.drop_lines(df, index, min_chars=5).collect()), key=str) == brute(rows, 5, 5)
    with pytest.raises(ValueError):
        ld.drop_lines(df, index, min_docs=1)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ld.dedup_lines(df).collect() == []
    alone = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    assert [tuple(r) for r in ld.dedup_lines(alone).collect()] == [(1, 1, 0, "x" * 50)]
