"""Hard negatives against all scores in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, q string, key string, j int"


def brute(rows, every=10, positives=5, negatives=10):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, list(v), y) for i, v, y in dict.fromkeys((i, tuple(v), y) for i, v, y in rows)]
    out = []
    for i, v, y in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, w, z in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, every=10):
    df = spark.createDataFrame([(*r, "q", "k", 0) for r in rows], SCHEMA)
    return sorted(map(tuple, hn.hard_negatives(hn.prepared(df), F.col("id") % every == 0).collect()))


def vectors(n, dims, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    return [(i, [float(np.float32(x)) for x in scale * (centres[y] * (i % 3) + rng.normal(size=dims))], y) for i, y in enumerate(rng.integers(0, 4, n).tolist())]


@pytest.mark.parametrize("bucket,chunk,block", [(16, 1 << 22, 2048), (64, 600, 3)])
def test_against_all_scores(spark, monkeypatch, bucket, chunk, block):
    for name, value in (("BUCKET", bucket), ("CHUNK", chunk), ("BLOCK", block)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors(300, 6, 1)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "BUCKET", 8)
    rows = vectors(80, 4, 2)
    rows += [(100, None, 1), (110, [1.0, None, 2.0, 0.0], 1), (120, [1.0, float("nan"), 0.0, 0.0], 2), (130, [float("inf"), 0.0, 0.0, 0.0], 0), (140, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1)]
    rows += [(150, [], 1), (160, [0.0, 0.0, 0.0, 0.0], 1), (170, [1.0], 2), (180, [-1e-20, 0.0, 0.0, 0.0], 3), (190, [0.5, 0.5, 0.5, 0.5], 9)]
    rows += [(i, [0.5, -0.25, 0.125, 1.0], i % 2) for i in range(200, 240)]  # one vector many times, both labels
    rows += [(200, [0.5, -0.25, 0.125, 1.0], 0), (200, [2.0, 1.0, 0.0, 0.0], 1)]  # a row again; its id with another
    assert found(spark, rows) == brute(rows)


def test_long_components(spark):
    rows = vectors(60, 3, 3, scale=1e5)
    assert found(spark, rows) == brute(rows)
    few = [(i, [float(2**21 + i), float(-(2**20)), 1.0], i % 2) for i in range(12)]
    assert found(spark, few) == brute(few)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert found(spark, [(10, [1.0], 0)]) == []


def test_pruning_leaves_rows_out():
    rng = np.random.default_rng(4)
    rows = np.floor(256 * rng.normal(size=(5000, 16)))
    buckets = hn._buckets(np.arange(5000), np.zeros(5000, np.int64), rows, 1024)
    scores = np.sort(rows @ rows[7])[::-1]
    seen = []
    hn._search(buckets, rows[7], lambda: int(scores[9]), lambda s, i, y: seen.append(s))
    met = np.concatenate(seen)
    assert np.sort(met)[::-1][:10].tolist() == scores[:10].astype(int).tolist()
    assert len(met) < 3500
