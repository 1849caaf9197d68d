"""Near-duplicate groups against all pairs in plain Python."""

import random
import re

import pytest

from ridgeline.llm import near_dedup as nd


def brute(rows, threshold):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 10000 * n >= round(10000 * threshold) * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,threshold", [(512, 0.85), (16, 0.8)])
def test_against_all_pairs(spark, block, threshold, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = [None, "", "  ", "one", "One", "one two", "one two three four", "ONE two three four", "a b c d e", "a b c d e f"]
    for n in (30, 150, 700):
        texts += family(rng, [rng.choice(words) for _ in range(n)], 40, n // 12)
    texts += [" ".join([*shared, *(rng.choice(words) for _ in range(rng.randint(5, 200)))]) for _ in range(80)]
    texts += ["same copy of a text that is " + "long " * 9] * 30
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, n int, key string").repartition(3)
    monkeypatch.setattr(nd, "BLOCK", block)
    want = brute(rows, threshold)
    got = {r.id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, threshold).collect()}
    assert got == want
    if block == 512:
        kept = nd.keep_one(df.union(df), threshold)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (None, "q r s"), (4, "zz")], "doc_id long, text string")
    got = sorted(((r.id, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (None, None, True), (4, 4, True)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0
    assert sorted(map(str, (r.doc_id for r in nd.keep_one(df.union(df)).collect()))) == ["3", "4", "None"]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "quite another text of seven words", "y"), (1, "quite another text of seven words", "y"), (2, "A b c d e f g", "z"), (None, None, "n"), (None, None, "n"), (None, "", "e"), (5, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = nd.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[6], rows[7]], key=str)


def test_hot_value_and_chains(spark, monkeypatch):
    """A boilerplate of many texts makes no links; a chain over the blocks of one list is one group."""
    rng = random.Random(7)
    boiler = [f"b{i}" for i in range(12)]
    texts = [" ".join([*boiler, *(f"u{k}_{i}" for i in range(rng.randint(1, 30)))]) for k in range(600)]
    chain = [f"c{i}" for i in range(120)]
    for k in range(150):
        chain[(k * 7) % 120] = f"d{k}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    monkeypatch.setattr(nd, "BLOCK", 32)
    monkeypatch.setattr(nd, "HUBS", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, 0.5).collect()}
    assert got == brute(rows, 0.5)


def test_least_overlap_is_a_bound():
    rng = random.Random(3)
    for threshold in (0.85, 0.5):
        for _ in range(2000):
            n = rng.randint(1, 90)
            a = {rng.random() for _ in range(n)}
            b = set(rng.sample(sorted(a), max(1, round(n * rng.uniform(threshold, 1)))))
            if len(a & b) >= threshold * len(a | b):
                common = len(set(sorted(a)[: nd.SKETCH]) & set(sorted(b)[: nd.SKETCH]))
                assert common >= max(nd.least_overlap(len(a), threshold), nd.least_overlap(len(b), threshold))
