"""Source divergence against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from ridgeline.llm import divergence as dv

SCHEMA = "text string, lang string, source string, doc_id long, term string, n string, digest int"


def brute(rows, min_docs=10):
    counts, holders, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang or "", source or ""].update(terms)
        holders[lang or ""].update(set(terms))
    for lang in {g for g, _ in counts}:
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}  # noqa: B023

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def documents():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["été", "naïve", "中文", "Ünïq"]
    rows = [(" ".join(words[(i * k + k * k) % len(words)] for k in range(1 + i % 40)) + ", The_END-of 12x34 doc!\x00", ("en", "de", None)[i % 3], f"s{i * i % 11}" if i % 7 else None) for i in range(400)]
    rows += [(None, "en", "null text"), ("", "fr", "empty"), ("123 456", "fr", "digits"), ("seldom words here", "fr", None), ("x " * 50_000 + "été " * 9, "en", "long"), ("y" * 100_000, "en", "long"), ("ties ties", "en", "long")]
    return rows + [("again and again", "es", "copies")] * 12 + [("again", "es", "other")]


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "t", "n", 2) for r in rows], SCHEMA)
    return sorted(map(tuple, dv.divergence(df, **more).collect()))


@pytest.mark.parametrize("bits,terms,tile,held,counts,piece", [(64, 4096, 64, 500_000, 1 << 22, 1 << 20), (5, 40, 3, 50, 10**6, 100), (9, 40, 3, 10**6, 300, 100)])
def test_against_brute_force(spark, monkeypatch, bits, terms, tile, held, counts, piece):
    for name, value in (("TERMS", terms), ("TILE", tile), ("HELD", held), ("COUNTS", counts), ("PIECE", piece)):
        monkeypatch.setattr(dv, name, value)
    rows = documents()
    assert found(spark, rows, bits=bits) == brute(rows)


def test_large_counts(spark):
    from pyspark.sql import functions as F

    n = [10**9 - 1, 10**12, 3 * 10**15]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    got = df.select(dv._share(F.col("n"), F.lit(4 * 10**15), F.lit(7)).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (x + 2) // (4 * 10**15 + 14) for x in n]


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None, None)]) == []
    assert found(spark, [(None, None, "a"), ("few", None, "b")]) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
