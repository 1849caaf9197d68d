"""Token files, unigram counts, language mixtures and source mixing against plain Python."""

import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import direct_codes as dc
from ridgeline.llm import language_id as li
from ridgeline.llm import mixing as mx
from ridgeline.llm import token_output as to
from ridgeline.llm import unigram_count as uc
from ridgeline.storage import scratch

WORDS = P.path("word_bpe_49k.json")
ODD = ["", None, "a", "It's DON'T  stop!!", "É é É ÀÇ ß İ ΑΣ Σ", "tab\tnew\nline\x0b\x1c wide", "<|endoftext|> x <|ENDOFTEXT|>", "123 4,5.6 x1y2", "日本語 テキスト", "🙂🙂 ok", "é ́x", "don’t “quote”", "word " * 30_000, "z" * 5000]


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = [*enumerate(ODD), (None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, file string")
    folder = scratch(spark, "t")
    manifest = to.write_tokens(df, WORDS, 2, folder)
    got = sorted(map(tuple, to.read_digests(manifest, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    texts = {d: [x for k, x in rows if k == d] for d, _ in rows}
    at = 0
    for d, start, n, crc in got:
        options = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for x in texts[d]]
        assert start == at and (n, crc) in [(len(o), zlib.crc32(o.tobytes())) for o in options]
        at += n
    assert to.read_digests(to.write_tokens(df.limit(0), WORDS, 2, folder), folder).count() == 0


def test_direct_addressing(tmp_path):
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2**k, 3000) for k in (4, 8, 12, 20, 31)]).astype(np.uint32)
    rng.shuffle(ids)
    w = dc.ShardWriter(str(tmp_path), "x")
    old, dc.SEGMENT = dc.SEGMENT, 4096
    try:
        for i, part in enumerate(np.array_split(ids, 7)):
            w.add(i, part)
        w.add(9, ids[:0])
        assert w.close() == len(ids)
    finally:
        dc.SEGMENT = old
    r = dc.ShardReader(str(tmp_path), "x")
    for i in [0, 1, 511, 512, 4095, 4096, len(ids) - 1, *rng.integers(0, len(ids), 300).tolist()]:
        assert r.token(i) == ids[i]
    for a, b in [(0, 10), (500, 1030), (4000, 9000), (14990, 15000)]:
        assert np.array_equal(np.concatenate(list(r.ranges(a, b))), ids[a:b])


def test_unigram_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = P.path("piece_bpe_32k.model")
    vocabulary = uc.read_vocabulary(path)
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=uc.SPACE, prepend_scheme="always", split=False)
    texts = [x or "" for x in ODD] + [" lead", "\nline", "a \nb", "▁raw", "two  spaces", "<0x41> <s>"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, x or None, 1) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int")
    # The library prepends nothing to a text that begins with the mark itself, as a space becomes one: there, marks are written out.
    bare = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    for r in uc.count_tokens(df, path).collect():
        text = texts[r.id]
        whole = t if not text.startswith((" ", uc.SPACE)) else bare
        given = text if whole is t else uc.SPACE + text.replace(" ", uc.SPACE)
        assert r.n_tokens == (len(whole.encode(given).ids) if text else 0), text[:50]
        assert r.n_bytes == len(text.encode())
    assert uc.count_tokens(df.limit(0), path).count() == 0


def test_unigram_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    rng = np.random.default_rng(3)
    vocabulary = [("<unk>", -9.0), (uc.SPACE, -2.0), *((p, -float(s)) for p, s in zip(["a", "b", "ab", "ba", "aa", "aba", "bab", "abab", "c"], [1, 1, 2, 2, 2, 3, 3, 4, 2], strict=True))]
    counter, t = uc.UnigramCounter(vocabulary), Tokenizer(models.Unigram(vocabulary, unk_id=0))
    for _ in range(300):
        unit = "".join(rng.choice(list("abcxy"), rng.integers(1, 14)))
        assert counter.count_unit(unit) == len(t.encode(unit).ids), unit


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.train(docs.filter(~li.is_held_out()))
    found = li.with_language(docs.withColumn("score", F.lit("x")), model).filter(li.is_held_out())
    rows = found.select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_edges(spark):
    en = "the house of the people and their work was good for this year " * 8
    de = "der hund und die katze sind nicht in dem haus weil sie schlafen " * 8
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([(en, "en"), (de, "de")] * 10)] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    model = li.train(train)
    assert model.languages == ["de", "en"]
    shares = dict(model.shares(en + de))
    assert len(shares) == 2 and all(0.3 < s < 0.7 for s in shares.values())
    assert len(model.shares(en)) == 1
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "12 34!"), (4, "a"), (5, en * 500), (5, en)], "doc_id long, text string")
    got = li.with_language(edge, model).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and got[0].score == 0 and got[4].lang_pred == got[5].lang_pred == "en"
    assert li.with_language(edge.limit(0), model).count() == 0
    assert {r.lang_pred for r in li.with_language(edge, li.train(train.limit(0))).collect()} == {"und"}


def brute_mix(rows, limit):
    """rows: id -> source, tokens; the copies of each id by plain running sums."""
    sums = {}
    for s, n in rows.values():
        sums[s] = sums.get(s, 0) + n
    total = sum(sums.values())
    p = {s: n / total for s, n in sums.items() if n}
    ratio = max(p.values()) / min(p.values())
    a = max(0.0, 1 - math.log(limit) / math.log(ratio)) if ratio > limit else 0.0
    z = sum(x**a for x in p.values())
    budget = max(sums[s] * z / x**a for s, x in p.items())
    copies = {}
    for s in sums:
        own = budget * p[s] ** a / z if s in p else 0
        full = math.floor(own / sums[s] + 1e-9) if s in p else 1
        rest = math.floor(max(0, own - full * sums[s]) + 1e-6) if s in p else 0
        import hashlib

        order = sorted((i for i, (x, _) in rows.items() if x == s), key=lambda i: (hashlib.md5(f"mix|{full}|{i}".encode()).hexdigest(), i))
        upto = 0
        for i in order:
            upto += rows[i][1]
            copies[i] = full + (upto <= rest and rows[i][1] > 0)
    return copies


def test_mixing(spark):
    rng = np.random.default_rng(5)
    rows = {i: (["hot", "b", "c", None][min(3, int(rng.integers(0, 9)) // 2)], int(rng.integers(0, 30))) for i in range(400)}
    df = spark.createDataFrame([(i, "w " * n if n else None, s, "k") for i, (s, n) in rows.items()], "doc_id long, text string, source string, key string")
    got = {r.doc_id: r.n for r in mx.mix_documents(df, max_repetition=1.5).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == brute_mix(rows, 1.5)
    assert mx.mix_documents(df, max_repetition=1.5).columns == df.columns
    twice = df.limit(3).unionAll(df.limit(3))
    assert mx.mix_documents(twice, max_repetition=1.0).groupBy("doc_id").count().agg(F.min("count")).first()[0] >= 2
    assert mx.mix_documents(df.limit(0), max_repetition=2).count() == 0
    assert mx.mix_documents(df.filter("text IS NULL"), max_repetition=2).count() == sum(n == 0 for _, n in rows.values())


def test_exponent(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    a = mx.find_exponent(shares, max_repetition=2.0)
    assert a == pytest.approx(1 - math.log(2) / math.log(7), abs=1e-9)
    a = mx.find_exponent(shares, target_entropy=1.0)
    w = np.array([0.7, 0.2, 0.1]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-9)
    many = np.random.default_rng(2).pareto(1.0, 3000) + 1e-3
    many /= many.sum()
    old, mx.BINS = mx.BINS, 512
    a = mx.find_exponent(spark.createDataFrame([(float(p),) for p in many], "p double"), target_entropy=7.0)
    mx.BINS = old
    w = many**a / (many**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(7.0, abs=1e-4)


def test_mixing_with_clashing_columns_and_null_ids(spark):
    rows = [(None, "a b", "s", 1, "x", 5), (None, "c", "s", 2, "y", 6), (3, "d e f", None, 3, "z", 7), (3, "d e f", None, 4, "w", 8), (4, "w " * 50_000, "long", 5, "v", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, unit int, row string, times int")
    got = mx.mix_documents(df, max_repetition=1.0)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def plain_mixture(p, n, rounds):
    """Expectation-maximisation with loops."""
    k, pi = len(p), [1 / len(p)] * len(p)
    for _ in range(rounds if k > 1 else 0):
        share = [0.0] * k
        for g, count in enumerate(n):
            total = sum(pi[j] * p[j][g] for j in range(k))
            for j in range(k):
                share[j] += count * pi[j] * p[j][g] / total
        new = [x / sum(n) for x in share]
        moved = max(abs(a - b) for a, b in zip(new, pi, strict=True))
        pi = new
        if moved < 1e-4:
            break
    return pi, sum(c * math.log(sum(pi[j] * p[j][g] for j in range(k))) for g, c in enumerate(n))


def test_language_mixture_against_loops(spark):
    rng = np.random.default_rng(6)
    for k in (1, 2, 4):
        p = rng.dirichlet(np.ones(30), k)
        n = rng.integers(1, 9, 30).astype(float)
        pi, fit = li.mixture(p, n)
        want, best = plain_mixture(p.tolist(), n.tolist(), li.ROUNDS)
        assert np.allclose(pi, want) and fit == pytest.approx(best)
    # The set of languages of whole texts, from counts and penalties written out.
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL").limit(25).collect() if li.has_letter(r.text)]
    model = li.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), rows_per_language=50)
    for text in docs:
        grams = {}
        for g in li.gram_buckets(text[:3000]).tolist():
            grams[g] = grams.get(g, 0) + 1
        seen = sorted(grams)
        n, p = [grams[g] for g in seen], model.probs[:, seen]
        order = np.argsort(-np.array(plain_mixture(p.tolist(), n, li.ROUNDS)[0]), kind="stable")
        best, found = -math.inf, {}
        for k in range(1, len(order) + 1):
            pi, fit = plain_mixture(p[order[:k]].tolist(), n, li.ROUNDS)
            score = fit - 0.5 * math.log(max(2.0, sum(n) / 3)) * (k - 1)
            if score <= best:
                break
            best, found = score, dict(zip(order[:k].tolist(), pi, strict=True))
        assert dict(model.shares(text[:3000])) == pytest.approx(found)


def test_other_tokenizers_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    from ridgeline.llm.wordcodes import WordEncoder, by_words

    path = P.path("byte_bpe_50k.json")
    assert by_words(WORDS) and not by_words(path)
    t = Tokenizer.from_file(path)
    texts = [x or "" for x in ODD]
    got = WordEncoder(path).encode([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_the_cache_of_words_takes_a_bounded_part_of_a_worker(spark):
    import sys

    from tokenizers import Tokenizer

    from ridgeline.llm.wordcodes import WordEncoder

    t, encoder = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    for low in range(0, 450_000, 15_000):
        text = " ".join("".join(chr(97 + k // 26**j % 26) for j in range(5)) for k in range(low, low + 15_000))
        got = encoder.encode([text.encode()])
        if low % 150_000 == 0 or low == 435_000:
            assert np.frombuffer(got[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    held = sys.getsizeof(encoder.cache) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in encoder.cache.items())
    assert len(encoder.cache) > 100_000
    assert held < 36 << 20
    # Long words count by their bytes.
    encoder.encode([" ".join(f"{k}-" * 20_000 for k in range(100, 200)).encode()])
    assert max(map(len, encoder.cache)) < 100
