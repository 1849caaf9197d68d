"""Repeated substrings against a plain scan over all windows."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import substring_dedup as sd
from ridgeline.llm.batches import ROWS
from ridgeline.llm.bwt import class_starts


def brute(rows, length):
    """(id, text) rows, ids distinct, to removed masks."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        out[d] = gone
    return out


@pytest.mark.parametrize("seed", range(6))
def test_transform_gives_classes(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + [2, 4, 26][seed % 3], 60).astype(np.uint8)
    text = np.concatenate([np.concatenate([base[rng.integers(0, 30) :], [255]]) for _ in range(20)]).astype(np.uint8)
    for depth in (8, 12, 21):
        suffixes, begin = class_starts(text, depth)
        raw = text.tobytes() + b"\xfe"
        ring = raw + bytes(depth)
        got = [ring[s : s + depth] for s in suffixes]
        assert got == sorted(got)
        assert begin.tolist() == [True] + [a != b for a, b in zip(got, got[1:], strict=False)]


def corpus(rng):
    letters = "abcdefgh éü\n"
    prose = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, page = prose(260), prose(1500)
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 350, page, page, page.upper()]
    for _ in range(40):
        t = list(page)
        for _ in range(rng.randint(1, 12)):
            t[rng.randrange(len(t))] = rng.choice(letters)
        texts.append("".join(t))
    for _ in range(40):
        cut = passage[rng.randint(0, 60) : rng.randint(150, 260)]
        texts.append(prose(rng.randint(0, 300)) + cut + prose(rng.randint(0, 300)) + cut[: rng.randint(50, 140)])
    texts += [prose(120) * 5, prose(40_000) + passage]
    return texts


@pytest.mark.parametrize("hot", [2000, 3, 0])
def test_against_all_windows(spark, hot, monkeypatch):
    rng = random.Random(8)
    texts = corpus(rng)
    ids = rng.sample(range(-50, 900), len(texts) - 1) + [None]
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id long, text string, doc int, bytes binary").repartition(4)
    monkeypatch.setattr(sd, "HOT", hot)
    truth = brute(rows, 100)
    got = sd.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        b, gone = (dict(rows)[r.id] or "").encode(), truth[r.id]
        mask = np.zeros(len(b), bool)
        for s in r.spans:
            mask[s.start : s.stop] = True
        assert r.n_bytes == len(b) and np.array_equal(mask, gone), r.id
        assert bytes(r.kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert all(x.stop < y.start for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_repeated_rows(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdef") for _ in range(300)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (1, a), (1, b + a), (2, a)], "doc_id long, text string")
    got = {}
    for r in sd.remove_repeats(df).collect():
        got.setdefault((r.id, r.n_bytes), set()).add(sum(s.stop - s.start for s in r.spans))
    first = zlib.crc32(a.encode()) < zlib.crc32((b + a).encode())
    assert got == {(1, 300): {0 if first else 300}, (1, 600): {300 if first else 0}, (2, 300): {300}}
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_parts_that_stay_crowded(spark, monkeypatch):
    """One stretch of 86 bytes, then a counter: a second round parts them."""
    monkeypatch.setattr(sd, "HOT", 20)
    rng = random.Random(3)
    stretch = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(86))
    rows = [(k, f"{rng.random()}" * 3 + stretch + f"{k % 90:04d}" * 12) for k in range(120)]
    split, rounds = sd._split, []
    monkeypatch.setattr(sd, "_split", lambda runs, length, ranges: (rounds.append(ranges), split(runs, length, ranges))[1])
    truth = brute(rows, 100)
    for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        mask = np.zeros(r.n_bytes, bool)
        for s in r.spans:
            mask[s.start : s.stop] = True
        assert np.array_equal(mask, truth[r.id]), r.id
    assert rounds == [4, 16]


def planned(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def python_nodes(node, above=0):
    """Most Python nodes of a plan that one task runs one over the other; all of them."""
    above = 0 if node.nodeName().startswith("Exchange") else above + (node.nodeName() == "MapInArrow")
    below = [python_nodes(node.children().apply(k), above) for k in range(node.children().size())]
    return max([above, *(b[0] for b in below)]), (node.nodeName() == "MapInArrow") + sum(b[1] for b in below)


def test_memory_of_tasks(spark, monkeypatch):
    """Texts reach Python a thousand rows at a time, tasks have one worker each, and texts aren't cut in Python."""
    setting, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, sd.materialise
    before = spark.conf.get(setting)

    def spy(df, name):
        seen.setdefault(name, []).append((int(spark.conf.get(setting)), python_nodes(planned(df))))
        return written(df, name)

    monkeypatch.setattr(sd, "HOT", 3)
    monkeypatch.setattr(sd, "materialise", spy)
    rows = list(enumerate(corpus(random.Random(5))))
    spark.conf.set(setting, "10000")
    try:
        got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        assert spark.conf.get(setting) == "10000"
    finally:
        spark.conf.set(setting, before)
    assert {"repeat-runs", "repeat-bytes", "repeat-parts", "repeat-ranges"} <= set(seen)
    assert {rows for found in seen.values() for rows, _ in found} == {ROWS}
    assert {most for found in seen.values() for _, (most, _) in found} == {0, 1}
    assert python_nodes(planned(got)) == (0, 0)


def test_memory_of_a_transform():
    rng = np.random.default_rng(4)
    rows = [(k, 0, 0, 50, rng.integers(97, 123, 149).astype(np.uint8).tobytes()) for k in range(sd._TEXT_BYTES // 150)]
    tracemalloc.start()
    try:
        assert not list(sd.repeated_windows(rows, 100))
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_ranges_are_united():
    rng = random.Random(6)
    lists = [[(a, a + rng.randint(1, 30)) for a in (rng.randrange(400) for _ in range(rng.randint(1, 12)))] for _ in range(2 * ROWS + 100)]
    lists[0] = [(0, 5), (5, 9), (10, 12), (3, 4)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    ranges = pa.array([[{"start": a, "stop": b} for a, b in found] for found in lists], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array([7] * len(lists)), ranges], ["doc", "sub", "ranges"])
    got = [r for b in sd._united([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert [(r["doc"], r["sub"]) for r in got] == [(k, 7) for k in range(len(lists))]
    assert got[0]["spans"] == [{"start": 0, "stop": 9}, {"start": 10, "stop": 12}]
    for r, found in zip(got, lists, strict=True):
        gone = np.zeros(500, np.int8)
        for a, b in found:
            gone[a:b] = 1
        edge = np.flatnonzero(np.diff(gone, prepend=0, append=0)).tolist()
        assert [(x["start"], x["stop"]) for x in r["spans"]] == list(zip(edge[::2], edge[1::2], strict=True))
