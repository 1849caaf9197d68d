"""Source divergence audit: how the terms of each source differ from its language's.

Tasks count terms where the texts lie and write arrays of 64-bit digests and counts for
each language and source, and once for each language the terms themselves, with the
number of documents that hold them. Counts are shuffled with digests alone. Of the kept
digests, which a bitmap of fixed size lets through, tasks send on the smallest and the
largest string: where those differ, two terms share a digest, which is split, its terms
being counted by their text. Text comes back at the end, for the terms that are reported.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A
language keeps the V terms of at least ``min_docs`` of its documents. A kept term with
``count`` occurrences of a group's N (of kept terms) has p = 1 + floor(10^9 (count + 2) /
(N + 2 V)); two values p and q differ by floor((p - q)^2 / (p + q)). All numbers are whole;
products that 64 bits can't hold are decimals.

Pairs of sources are summed by blocks of about ``TERMS`` terms and tiles of ``TILE``
sources: a task lays a block out as an array, so no row per pair and term is made, and a
language's terms and a hot source's are spread over all blocks.

Null texts, languages and sources are read as ''. Rows are documents, also those alike or
with one id. Groups whose documents have no term are groups all the same. A document with
any number of terms is counted a piece at a time. Ties go to the smaller term in UTF-8
order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.bitmaps import bitmap, has
from ridgeline.storage import materialise

MIN_DOCS, SCALE, REPORTED = 10, 1_000_000_000, 10
#: Distinct terms and counts of documents that a task holds before it hands them on, and bytes of a text that it splits at a time.
HELD, COUNTS, PIECE = 500_000, 1 << 22, 1 << 20
#: Values of an array in a row.
ROW = 50_000
#: Terms of a block and sources of a tile: an array of at most 2 x 64 x 4096 numbers, about.
TERMS, TILE = 4096, 64

#: Bytes of terms: letters, lower-cased, and all of UTF-8's bytes beyond ASCII. Others part them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def digest(term: bytes, bits: int = 64) -> int:
    return (xxhash.xxh3_64_intdigest(term) & ((1 << bits) - 1)) - (1 << 63)


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """A text's terms, some at a time; no term is cut."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + size)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class _Numbers(dict):
    """Numbers terms in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


_ROWS = "lang string, source string, digests array<long>, counts array<long>, terms array<binary>"


def _row(lang: str, source: str | None, digests: np.ndarray, counts: np.ndarray, terms: list[bytes] | None) -> Iterator[pa.RecordBatch]:
    for i in range(0, max(len(digests), 1), ROW):
        at = slice(i, i + ROW)
        lists = [pa.array([x[at]], pa.list_(pa.int64())) for x in (digests, counts)]
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([source], pa.string()), *lists, pa.array([None if terms is None else terms[at]], pa.list_(pa.binary()))], ["lang", "source", "digests", "counts", "terms"])


def _counted(bits: int, held: int, most: int, piece: int, only: np.ndarray | None):
    """Rows of a source's counts without terms, and of a language's documents with terms, whose source is null.

    With a bitmap ``only``, the counts of the digests that are in it, with their terms.
    """

    def emit(vocab: dict, groups: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        digests = {lang: np.fromiter((digest(t, bits) for t in v), np.int64, len(v)) for lang, v in vocab.items()}
        terms = {lang: list(v) for lang, v in vocab.items()}
        for (lang, source), parts in groups.items():
            ids, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(ids, kind="stable")
            ids, starts = np.unique(ids[order], return_index=True)
            n = np.add.reduceat(n[order], starts) if len(ids) else n
            if only is None:
                yield from _row(lang, source, digests[lang][ids], n, None)
            else:
                hit = has(only, digests[lang][ids].view(np.uint64))
                yield from _row(lang, source, digests[lang][ids[hit]], n[hit], [terms[lang][i] for i in ids[hit]])
        for lang, parts in docs.items() if only is None else ():
            yield from _row(lang, None, digests[lang], np.bincount(np.concatenate(parts), minlength=len(terms[lang])), terms[lang])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, groups, docs, size = defaultdict(_Numbers), defaultdict(list), defaultdict(list), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source")), batch.column("text"), strict=True):
                number, found = vocab[lang], [np.zeros(0, np.int64)]
                for terms in _pieces(text.as_py().translate(_FOLD), piece):
                    found.append(np.fromiter(map(number.__getitem__, terms), np.int64, len(terms)))
                ids, n = np.unique(np.concatenate(found), return_counts=True)
                groups[lang, source].append((ids.astype(np.int32), n))
                docs[lang].append(ids.astype(np.int32))
                size += len(ids)
                if size >= most or sum(map(len, vocab.values())) >= held:
                    yield from emit(vocab, groups, docs)
                    vocab, groups, docs, size = defaultdict(_Numbers), defaultdict(list), defaultdict(list), 0
        yield from emit(vocab, groups, docs)

    return count


def count_terms(docs: DataFrame, bits: int = 64, only: np.ndarray | None = None) -> DataFrame:
    """lang, source, digests, counts, terms: partial counts; each group has a row at least, if an empty one."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_counted(bits, HELD, COUNTS, PIECE, only), _ROWS).withColumn("terms", F.col("terms").cast("array<string>"))


def _among(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows of ``count_terms`` without the digests that aren't in a bitmap."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("digests")
            hit = has(bits, lists.flatten().to_numpy().view(np.uint64))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            offsets = pa.array(np.concatenate([[0], np.cumsum(hit)])[ends], pa.int32())
            cut = {c: pa.ListArray.from_arrays(offsets, batch.column(c).flatten().filter(pa.array(hit))) for c in ("digests", "counts", "terms") if batch.column(c).null_count == 0}
            out = [cut.get(c, batch.column(c)) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return rows.mapInArrow(sift, rows.schema)


def _each(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each place of the arrays; names lose their plural."""
    zipped = F.arrays_zip(*[F.col(c).alias(c[:-1]) for c in columns])
    return rows.select("lang", "source", F.inline(zipped)).toDF("lang", "source", *(c[:-1] for c in columns))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term; decimals hold the product."""
    top, bottom = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept == 0, F.lit(1).cast("long")).otherwise(F.call_function("div", top, bottom) + 1)


def _kept(docs: DataFrame, partial: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, digest, tie, term), and their counts by source (lang, source, digest, tie, n).

    ``tie`` is the term where another term of the language has its digest, and '' elsewhere.
    """
    held, sums = partial.filter("source IS NULL"), partial.filter("source IS NOT NULL")
    often = _each(held, "digests", "counts").groupBy("lang", "digest").agg(F.sum("count").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "digest")
    often = materialise(often, "often")
    # A bitmap of fixed size keeps most of the rare terms from any shuffle; the join settles the rest.
    kept = bitmap(often, "digest")
    worded = _each(_among(held, kept), "digests", "counts", "terms")
    known = materialise(worded.groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")).join(often, ["lang", "digest"]), "lexicon")
    alone, shared = known.filter("low = high"), known.filter("low <> high").select("lang", "digest")
    counts = _each(_among(sums, kept), "digests", "counts").groupBy("lang", "source", "digest").agg(F.sum("count").alias("n"))
    terms = alone.select("lang", "digest", F.lit("").alias("tie"), F.col("low").alias("term"))
    counts = counts.join(alone.select("lang", "digest"), ["lang", "digest"]).withColumn("tie", F.lit(""))
    if not shared.isEmpty():
        ties = worded.join(shared, ["lang", "digest"]).groupBy("lang", "digest", F.col("term").alias("tie")).agg(F.sum("count").alias("docs"))
        ties = materialise(ties.filter(F.col("docs") >= min_docs).select("lang", "digest", "tie"), "split-digests")
        texts = _each(count_terms(docs, bits, bitmap(shared, "digest")), "digests", "counts", "terms")
        again = texts.withColumnRenamed("term", "tie").groupBy("lang", "source", "digest", "tie").agg(F.sum("count").alias("n"))
        terms = terms.unionByName(ties.withColumn("term", F.col("tie")))
        counts = counts.unionByName(again.join(ties, ["lang", "digest", "tie"]))
    return materialise(terms, "kept-terms"), materialise(counts, "kept-counts")


def _groups(partial: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """Each group: its number within the language, its tile, the sums of the group and the language, kept terms and blocks."""
    sizes = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = partial.filter("source IS NOT NULL").select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "total"])
    lang = Window.partitionBy("lang")
    numbered = found.withColumns({"s": F.row_number().over(lang.orderBy("source")) - 1, "lang_total": F.sum("total").over(lang), "sources": F.count("*").over(lang)})
    out = numbered.withColumns({"tile": F.floor(F.col("s") / TILE).cast("int"), "tiles": F.ceil(F.col("sources") / TILE).cast("int"), "blocks": (F.floor(F.col("kept") / TERMS) + 1).cast("long")})
    return materialise(out.withColumn("none", _share(F.lit(0), F.col("total"), F.col("kept"))), "groups")


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _sums(table: pa.Table) -> pa.Table:
    """Sums of a block's differences for the pairs of one tile, or of two."""
    rows = table.select(["s", "tile", "digest", "tie", "p", "terms"]).to_pandas()
    group = rows.digest.isna()
    marks = rows[group].sort_values("s")
    sources, tile, none = (marks[c].to_numpy() for c in ("s", "tile", "p"))
    present = rows[~group]
    # Missing values made digests floating point, so they come from Arrow again.
    digests = table.column("digest").drop_null().to_numpy()
    at = present.assign(digest=digests).groupby(["digest", "tie"], sort=False).ngroup().to_numpy()
    width = int(at.max(initial=-1)) + 1
    p = np.repeat(none[:, None], width, axis=1)
    p[np.searchsorted(sources, present.s.to_numpy()), at] = present.p.to_numpy()
    rest = int(marks.terms.iloc[0]) - width  # terms that no source of these tiles has
    first, second = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
    out = ([], [], [])
    for i in np.flatnonzero(tile == first):
        others = np.flatnonzero((tile == second) & (sources > sources[i]))
        d, d0 = p[others] - p[i], none[others] - none[i]
        out[0].extend([sources[i]] * len(others))
        out[1].extend(sources[others])
        out[2].extend((d * d // (p[others] + p[i])).sum(axis=1) + rest * (d0 * d0 // (none[others] + none[i])))
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(out[0]), pa.string()), "a": pa.array(out[0], pa.int32()), "b": pa.array(out[1], pa.int32()), "value": pa.array(out[2], pa.int64())})


def _pairs(terms: DataFrame, shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all pairs of a language's sources."""
    at = F.pmod(F.xxhash64("digest", "tie"), F.col("blocks")).alias("block")
    sizes = terms.join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", at).agg(F.count("*").alias("terms"))
    marks = groups.select("lang", "s", "tile", "tiles", F.col("none").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    marks = marks.join(sizes, ["lang", "block"], "left").fillna(0, ["terms"]).withColumns({"digest": F.lit(None).cast("long"), "tie": F.lit("")})
    rows = shares.select("lang", "s", "tile", "tiles", "p", at, "digest", "tie", F.lit(0).cast("long").alias("terms")).unionByName(marks)
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
    sums = dealt.groupBy("lang", "block", "ta", "tb").applyInArrow(_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))).alias("x")).select("lang", "value", "x.s", "x.o")
    named = both.join(groups.select("lang", "s", "source"), ["lang", "s"]).join(groups.select("lang", F.col("s").alias("o"), F.col("source").alias("item")), ["lang", "o"])
    return named.select("lang", "source", "item", "value")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, reported: int = REPORTED, bits: int = 64) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. ``bits`` of a digest are used."""
    partial = materialise(count_terms(docs, bits), "term-counts")
    terms, counts = _kept(docs, partial, min_docs, bits)
    groups = _groups(partial, terms, counts)
    overall = Window.partitionBy("lang", "digest", "tie")
    shares = counts.withColumn("overall", F.sum("n").over(overall)).join(groups, ["lang", "source"])
    shares = shares.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("kept")), "q": _share(F.col("overall"), F.col("lang_total"), F.col("kept"))})
    shares = materialise(shares.select("lang", "source", "s", "tile", "tiles", "blocks", "digest", "tie", "p", "q"), "shares")

    group = Window.partitionBy("lang", "source")
    above = shares.filter("p > q").withColumn("value", _difference(F.col("p"), F.col("q")))
    # Ties at the last rank wait for their strings.
    first = above.withColumn("r", F.rank().over(group.orderBy(F.desc("value")))).filter(F.col("r") <= reported)
    worded = first.select("lang", "source", "digest", "tie", "value").join(terms, ["lang", "digest", "tie"])
    best = worded.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = _pairs(terms, shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = group.orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, best)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= reported)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources and the leading terms of each, over all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') AS ts FROM documents),
     o AS (SELECT lang, source, doc_id, unnest(ts) AS term FROM d),
     c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
     k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
     g AS (SELECT DISTINCT lang, source FROM d),
     v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
     gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN (c JOIN k USING (lang, term)) USING (lang, source) GROUP BY ALL),
     ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
     p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (gn.total + 2 * v.v)::HUGEINT)::HUGEINT AS p
           FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
     l AS (SELECT k.lang, k.term, (1 + 1000000000::HUGEINT * (sum(c.n) + 2) // (any_value(ln.total) + 2 * any_value(v.v))::HUGEINT)::HUGEINT AS q
           FROM k JOIN c USING (lang, term) JOIN ln ON ln.lang = k.lang JOIN v ON v.lang = k.lang GROUP BY ALL),
     s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     best AS (SELECT p.lang, p.source, p.term AS item, (p.p - l.q) * (p.p - l.q) // (p.p + l.q) AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM best) WHERE rank <= 10
"""
