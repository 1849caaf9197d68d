"""Benchmark search against brute force over all passages."""

import random

import numpy as np
import pytest

from ridgeline.llm import decontaminate as dc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 40)), rng.integers(0, 6, rng.integers(1, 90))
        assert dc.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def test_energy():
    items = dc.read_items([(1, "a b c d e", None)])
    items.idf, items.other = np.array([1, 2, 3, 4, 5, 0, 0], np.float32), 2.0
    rows = dc._rows_of(np.array([0, 0, 1, 4, 4, 4, 5, 5], np.int32))
    assert rows.shape == (1, dc.PASSAGE)
    inside, whole = dc._energy(items, rows)
    assert inside[0] == pytest.approx(4 + 4 + 225) and whole[0] == pytest.approx(233 + 8)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    common, rare = [f"the{i}" for i in range(30)], [f"word{i}" for i in range(3000)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]

    items = {i: prose(rng.randint(15, 60)) for i in range(30)} | {50: prose(300)}
    docs, truth = {}, set()
    for d in range(300):
        body = prose(rng.randint(20, 400))
        if d % 3 == 0:
            i = rng.choice(list(items))
            leak = [w if rng.random() > 0.12 else "other" for w in items[i]] if d % 2 else list(items[i])
            at = rng.randint(0, len(body))
            body[at:at] = leak
            truth.add((d, i))
        docs[d] = " ".join(body)
    return items, docs, truth


def frames(spark, items, docs):
    d = spark.createDataFrame([(k, t, 0, "x") for k, t in docs.items()], "doc_id long, text string, item_id int, id string").repartition(3)
    b = spark.createDataFrame([(k, " ".join(w).upper() if isinstance(w, list) else w) for k, w in items.items()], "item_id long, text string")
    return d, b


def test_leaks_and_paraphrases(spark, corpus):
    items, docs, truth = corpus
    d, b = frames(spark, items, docs)
    got = {(r.id, r.item_id) for r in dc.find_items(d, b).collect()}
    brute = set()
    for k, t in docs.items():
        w = t.split()
        for i, x in items.items():
            best = max(lcs(w[s : s + 2 * len(x) + dc.PASSAGE], x) for s in range(0, len(w), 24)) / len(x)
            if best >= 0.8:
                brute.add((k, i))
    assert got >= brute
    assert len(got & truth) >= 0.97 * len(truth)  # a planted paraphrase may keep fewer words than the rule asks for
    assert not {k for k, _ in got} - {k for k, _ in truth}
    clean = dc.drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == set(docs) - {k for k, _ in got}


def test_recall_does_not_hang_on_rank_or_blocks(spark, corpus, monkeypatch):
    items, docs, truth = corpus
    d, b = frames(spark, items, docs)
    full = {(r.id, r.item_id) for r in dc.find_items(d, b).collect()}
    assert {(r.id, r.item_id) for r in dc.find_items(d, b, rank=8).collect()} == full
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 11)
    some = {(r.id, r.item_id) for r in dc.find_items(d, b).collect()}
    assert some == full


def test_edges(spark):
    text = "one two three four five six seven eight nine ten"
    d, b = frames(spark, {1: text, 2: None, 3: "", 4: "too short", 5: text}, {1: None, 2: "", 3: text, 4: "zz " * 40_000 + text})
    got = sorted((r.id, r.item_id) for r in dc.find_items(d.union(d), b).collect())
    assert got == sorted([(3, 1), (3, 5), (4, 1), (4, 5)] * 2)
    assert dc.find_items(d.limit(0), b).count() == 0
    assert dc.find_items(d, b.limit(0)).count() == 0
    assert dc.drop_contaminated(d, b.limit(0)).count() == d.count()
    nameless = spark.createDataFrame([(None, text), (None, "clean words only"), (7, text), (7, "other")], "doc_id long, text string")
    assert sorted(r.text for r in dc.drop_contaminated(nameless, b).collect()) == ["clean words only", "other"]


def test_short_items_and_repeated_words(spark):
    """Every document that meets the rule in some span, however short its item or diluted the passage."""
    rng = random.Random(8)
    common, rare = [f"the{i}" for i in range(12)], [f"word{i}" for i in range(2000)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    items = {k: prose(n) for k, n in enumerate([5, 6, 7, 8, 9, 10, 11, 12] * 4)} | {100 + k: [rng.choice(common) for _ in range(6)] + prose(4) for k in range(8)}
    docs = {}
    for k, words in items.items():
        body = prose(rng.randint(200, 300))
        at = rng.randint(60, 150)
        docs[k] = [*body[:at], *words, *body[at:]]
        # The same among a word of the item that is there twenty times.
        docs[1000 + k] = [*body[:at], *words, *[words[0]] * 20, *body[at:]]
    d, b = frames(spark, items, {k: " ".join(w) for k, w in docs.items()})
    got = {(r.id, r.item_id) for r in dc.find_items(d, b).collect()}
    parsed = dc.read_items([(k, " ".join(w), None) for k, w in items.items()])
    df = np.zeros(parsed.size, int)
    for w in docs.values():
        ids = parsed.read(" ".join(w))
        df[np.unique(ids[ids < parsed.size])] += 1
    dc.weigh(parsed, df, len(docs))
    answers = {k: [list(parsed.vocabulary)[w].decode() for w in a] for k, a in zip(parsed.ids, parsed.answers, strict=True)}
    want = set()
    for key, w in docs.items():
        for k, x in items.items():
            for s in range(0, len(w) - dc.PASSAGE + dc.STRIDE, dc.STRIDE):
                span = w[max(0, s - len(x)) : s + dc.PASSAGE + len(x)]
                share = lcs(span, x) / len(x)
                if share >= 0.8 or share >= 0.6 and lcs(span, answers[k]) / len(answers[k]) >= 0.6:
                    want.add((key, k))
                    break
    assert got == want
    assert {(k, k) for k in items} | {(1000 + k, k) for k in items} <= got


def test_phrases_and_answers(spark, monkeypatch):
    """Items of fewer than five words as phrases; the loose rule with an answer of its own, clauses in another order and other words."""
    items = {1: "alpha", 2: "red green blue", 3: "one two three four", 4: "..."}
    docs = {1: "x alpha y", 2: "red blue green", 3: "so RED, green: blue!", 4: "one two x three four", 5: "zz " * 3000 + "one two three four"}
    d, b = frames(spark, items, docs)
    assert sorted((r.id, r.item_id) for r in dc.find_items(d, b).collect()) == [(1, 1), (3, 2), (5, 3)]
    rng = random.Random(11)
    rare = [f"word{i}" for i in range(4000)]
    bench, texts, want = [], {}, set()
    for k in range(40):
        question = rng.sample(rare, 30)
        answer = question[24:30]
        bench.append((k, " ".join(question), " ".join(answer)))
        # A clause moved to the end, some words replaced: 0.6 and more of the item is left in order.
        other = [w if i >= 24 or rng.random() > 0.12 else rng.choice(rare) for i, w in enumerate(question)]
        body = rng.sample(rare, 200)
        texts[k] = " ".join(body[:90] + other[6:] + other[:6] + body[90:])
        texts[100 + k] = " ".join(body)
        lost = [w if i < 24 else rng.choice(rare) for i, w in enumerate(question)]
        texts[200 + k] = " ".join(body[:50] + lost[9:] + body[50:])  # half of the item and none of its answer
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string, solution string")
    words = {k: t.split() for k, t in texts.items()}
    for key, w in words.items():
        for k, text, answer in bench:
            x, a = text.split(), answer.split()
            for s in range(0, len(w) - dc.PASSAGE + dc.STRIDE, dc.STRIDE):
                span = w[max(0, s - len(x)) : s + dc.PASSAGE + len(x)]
                if set(span) & set(x) and (lcs(span, x) >= 0.8 * len(x) or lcs(span, x) >= 0.6 * len(x) and lcs(span, a) >= 0.6 * len(a)):
                    want.add((key, k))
                    break
    got = {(r.id, r.item_id) for r in dc.find_items(d, b, answer_col="solution").collect()}
    assert got == want and len({(k, k) for k in range(40)} & got) >= 36 and not [x for x in got if x[0] >= 100]
    monkeypatch.setattr(dc, "BLOCK_BYTES", 3000)
    assert {(r.id, r.item_id) for r in dc.find_items(d, b, answer_col="solution").collect()} == want


def test_latent_space_is_of_all_passages(spark):
    """With as many directions as words, the basis has the singular vectors of the passages of all documents, and no others."""
    rng = random.Random(5)
    names = [f"w{k}" for k in range(24)]
    items = {k: rng.sample(names, 12) for k in range(6)}
    # Many more documents than any bounded sample would hold, of ten texts' worth of words that go together.
    kinds = [rng.sample(names, 5) for _ in range(400)]
    docs = {k: " ".join([*rng.choices(kinds[rng.randrange(400)], k=9), "else"]) for k in range(15_000)} | {20_000: " ".join(rng.choices(names, k=5000)), 20_001: None}
    d = spark.createDataFrame(list(docs.items()), "id long, text string").repartition(7)
    parsed = dc.read_items([(k, " ".join(w), None) for k, w in items.items()])
    frequencies, documents, words = dc.document_frequencies(d, parsed)
    texts = [parsed.read(t) for t in docs.values()]
    assert documents == len(docs) and words == sum(map(len, texts))
    dc.weigh(parsed, frequencies, documents)
    dc.fit_basis(d, parsed, words)
    n = parsed.size
    assert parsed.basis.shape == (n, n)
    rows = np.concatenate([dc._rows_of(t) for t in texts])
    counts = np.zeros((len(rows), n + 2))
    np.add.at(counts, (np.arange(len(rows))[:, None], rows), 1)
    a = counts[:, :n] * parsed.idf[:n]
    whole = (a**2).sum(1) + (counts[:, n] * parsed.other) ** 2 / np.maximum(1, counts[:, n])
    a /= np.sqrt(np.maximum(whole, 1e-9))[:, None]
    y = np.concatenate([y for _, y in dc._units(parsed)]).astype(float)
    gram = a.T @ a + dc.ITEM_WEIGHT * (a**2).sum() / len(y) * (y.T @ y)
    inner = parsed.basis.T.astype(float) @ gram @ parsed.basis
    # The items' own directions come first; in the others, passages alone tell directions from one another.
    own = inner[len(y) :, len(y) :]
    scale = np.sqrt(np.outer(own.diagonal(), own.diagonal()))
    assert np.abs(own - np.diag(own.diagonal())).max() < 1e-3 * scale.max()
