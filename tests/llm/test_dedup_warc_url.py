"""Exact dedup, WARC bundles and URL filter against plain Python."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from ridgeline.llm import exact_dedup as ed
from ridgeline.llm import url_filter as uf
from ridgeline.llm import warc
from ridgeline.storage import scratch

DOCS = "doc_id long, text string, size long, _bits string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_dedup(rows):
    best, count = {}, {}
    for d, t in rows:
        k = lower(t)
        count[k] = count.get(k, 0) + 1
        best[k] = max(best.get(k, -1), d if d is not None else -1)
    return sorted(((d, best[lower(t)], count[lower(t)], d == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in rows), key=str)


def test_exact_dedup(spark):
    long = "x Y " * 60_000
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, long), (8, long.lower()), (9, long[:-1] + "z"), (10, "abd"), (10, "abd"), *((i, "hot copy") for i in range(20, 60))]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], DOCS)
    found = ed.exact_dedup(df, hash_all=True)
    assert sorted(map(tuple, found.collect()), key=str) == brute_dedup(rows)
    part = ed.exact_dedup(df).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in part} == {(x[0], x[1], x[2], x[3]) for x in brute_dedup(rows)}
    assert [r.content_hash for r in part if r.id == 7] != [None]
    assert ed.exact_dedup(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "Same"), (None, "same"), (None, "x"), (7, "X")], "doc_id long, text string")
    assert sorted(((r.keep_id, r.group_size) for r in ed.exact_dedup(nameless).collect()), key=str) == [(7, 2), (7, 2), (None, 2), (None, 2)]


def test_warc(spark):
    big, long = "Ab é " * 300, "z" * 400_000
    rows = [(1, "http://a.com/x", big), (2, "http://b.com/\r\ny", big), (3, None, None), (4, "u", ""), (5, "v", "short"), (6, "w", "short"), (7, "x", long), (8, "x", long + "1"), *((i, "c", "copy " * 250) for i in range(20, 50)), (60, "d", big.upper())]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, frame string")
    folder = scratch(spark, "t")
    index = warc.write_archives(df, folder)
    got = {r.id: r for r in warc.read_archives(index, folder).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and len(data) >= 1000]
        best = max(same, default=i)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "response" if best == i else "revisit", None if best == i else best)
    for r in index.collect():
        head, block = warc.fetch(r, folder)
        assert head["warc-record-id"] == f"<urn:x-page:{r.id}>"
        if head["warc-type"] == "response":
            assert block.split(b"\r\n\r\n", 1)[1].decode() == (next(h for i, _, h in rows if i == r.id) or "")
    empty = warc.write_archives(df.limit(0), folder)
    assert warc.read_archives(empty, folder).count() == 0


def test_warc_nulls_repeats_and_tasks(spark):
    """Null and repeated ids, a hot payload, and a task for each file when there are as many files as shuffle partitions."""
    hot = "hot page " * 200
    rows = [(None, "a", hot), (None, "b", "tiny"), (5, "c", hot), (5, "c", hot), (4, "d", hot), (None, "e", None), *((10 + i, "f", f"{i} " * 600) for i in range(40))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = scratch(spark, "t")
    index = warc.write_archives(df, folder)
    back = warc.read_archives(index, folder)
    got = sorted((str(r.id), r.url, r.record_type, r.refers_to) for r in back.collect())
    best = {hot: 5}
    want = sorted((str(i), u, "revisit" if t in best and i != 5 else "response", 5 if t in best and i != 5 else None) for i, u, t in rows)
    assert got == want and index.count() == len(rows)
    files = index.select("file").distinct().count()
    assert back.select(F.spark_partition_id().alias("p"), "file").distinct().groupBy("p").count().agg(F.max("count")).first()[0] == 1
    assert back.select(F.spark_partition_id()).distinct().count() == files


def brute_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, k) for k, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7?x", "http://www.example.com/en/8", "http://notexample.com/en/7", "https://a.example.net/de/81#t", "https://a.example.net/de/1", "x://org/es/", "x://org?/es/", "http://a.org/es/://b", "https://poker-win.example.com/fr/3", "https://www.escorts-x.example.com/es/99", "https://free-betting.example.com/es/5", "https://linkfarm-5.example.com/es/5", "https://tionsh.example.com/fr/5", "https://m.theston.example.com/de/512"] * 2
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    model = uf.train(spark)
    for r in uf.filter_urls(df, model).collect():
        url = urls[r.id]
        assert (r.host, r.path) == brute_url(url), url
        rule, verdict = brute_rule(r.host, r.path)
        assert r.rule == rule
        if verdict is None:
            if r.host in ("org", "net", "com"):
                continue  # no name to judge by
            spam = re.search("poker|escorts|betting|linkfarm", url or "")
            verdict = "block" if spam else "allow"
        assert r.verdict == verdict, url
    assert uf.filter_urls(df.limit(0), model).count() == 0


def murmur3(data: bytes) -> int:
    """32-bit MurmurHash3 with seed 42, as a signed number."""
    h, full = 42, len(data) // 4 * 4
    rot = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    for i in range(0, full, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if data[full:]:
        h ^= rot(int.from_bytes(data[full:], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * times & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_model_recomputed(spark):
    """Scores of the whole pages table from the coefficients, with n-grams and hashing written anew."""
    model = uf.train(spark)
    weights, bias = model.coefficients.toArray(), model.intercept
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    for r in uf.filter_urls(pages, model).collect():
        host, path = brute_url(urls[r.id])
        text = f"^{host}|{path}$"
        places = {murmur3(text[i : i + n].encode()) % uf.BUCKETS for n in uf.NGRAMS for i in range(max(1, len(text) - n + 1))}
        score = 1 / (1 + math.exp(-bias - sum(weights[p] for p in sorted(places)))) if host or path else 0.0
        assert abs(r.score - score) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if score >= 0.5 else "allow")


def test_regression_on_unseen_hosts_and_subjects(spark):
    """Other affixes than the labels'; and every second subject, judged by the other half's model."""

    def judged(model, rows):
        df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
        got = [(r.verdict == "block", rows[r.id][1] == 1) for r in uf.filter_urls(df, model, rules=[]).collect()]
        return sum(v for v, y in got if y) / sum(y for _, y in got), sum(v for v, y in got if not y) / sum(not y for _, y in got)

    other = uf.labelled_urls(("best", "royal", "guild", "online", "net7", "our", "land"))
    assert not {brute_url(u)[0] for u, _ in uf.labelled_urls()} & {brute_url(u)[0] for u, _ in other}
    found, wrong = judged(uf.train(spark), other)
    assert found >= 0.9 and wrong <= 0.05
    for part in (0, 1):
        found, wrong = judged(uf.train(spark, uf.labelled_urls(part=part)), uf.labelled_urls(part=1 - part))
        print("unseen subjects:", found, wrong)
        assert wrong <= 0.1  # a subject that no n-gram names is allowed: what is found is README's figure


def test_no_label_word_is_a_host_of_pages(spark):
    hosts = {w for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect() for w in re.split(r"[.-]", brute_url(r.url)[0])}
    blocked, ordinary = uf.subjects()
    assert not hosts & {*blocked, *ordinary}
    assert not {*blocked} & {*ordinary} and len({*blocked, *ordinary}) == len(blocked) + len(ordinary) < 200


def test_after_a_query_that_observes(spark):
    """A session that was ever observed can't be sent to tasks, so no model may hold it."""
    from pyspark.sql import Observation

    seen = Observation()
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get["n"] == 3
    df = spark.createDataFrame([(1, "http://my-poker.example.com/fr/1")], "page_id long, url string")
    assert uf.filter_urls(df, uf.train(spark)).count() == 1
    assert uf.filter_urls(df, uf.train(spark)).collect()[0].verdict == "block"


def test_long_and_repeated_urls(spark):
    urls = ["https://poker-24.example.com/" + "x" * 50_000] * 2 + ["https://city-museum.example.com/" + "y/" * 30_000]
    df = spark.createDataFrame([(7, u) for u in urls], "page_id long, url string")
    got = uf.filter_urls(df, uf.train(spark), rules=[]).collect()
    assert sorted(len(r.path) for r in got) == [50_001, 50_001, 60_001] and len({r.score for r in got}) == 2
