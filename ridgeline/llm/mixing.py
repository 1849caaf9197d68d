"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0
(all sources alike) and 1 (as they are), normalised. Bisection finds the largest
exponent at which no source is repeated more often than ``max_repetition`` times the
least repeated one, or the exponent at which the weights have ``target_entropy``
(in nats; the nearest that 0..1 can give).

The weights are realised under a budget of tokens; by default it is the smallest with
which every document appears at least once, so nothing is dropped. A source goes
through its documents in epochs; each epoch is a permutation of its own (order of a
keyed hash), and the last is cut where the source's budget ends: a document of it
counts if its last token is within the budget. Each copy has a place in its source's
budget between 0 and 1, and so a block of the mixture: every block holds all sources
at the target weights, to within a document.

Places need running sums in hash order. They are made in two levels, within ranges of
the hash and over the sums of ranges, so that no source's documents meet in one task.

Tokens default to words that white space parts. Null texts have none; documents
without tokens appear in every full epoch. Null is a source of its own. Rows alike in
id, source and text are one unit that moves together; null ids are told apart by their
text. Very long texts are counted whole. An empty table, or one without a token, gives an
empty mixture of its rows' weights: each row appears once. Other columns, whatever their
names, go with their rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.storage import materialise

#: The exponent is found on the driver, from a histogram of so many bins at most.
BINS = 1 << 16
RANGE_ROWS = 4096
STEPS = 50


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _moments(shares: DataFrame) -> Callable[[float], tuple[float, float, float]]:
    """For an exponent a: sum of p^a, sum of p^a ln p, and the ratio of the extreme p^(a-1).

    Sources with equal shares are counted together. The counts of a histogram of ln p
    reach the driver, in ``BINS`` bins at most, each with its own mean: the sums are
    exact where bins hold one share each, and within 1e-9 of it where they don't.
    """
    edges = shares.agg(F.min("p"), F.max("p")).first()
    low, high = math.log(edges[0]), math.log(edges[1])
    width = max((high - low) / BINS, 1e-12)
    bins = shares.groupBy(F.floor((F.log("p") - low) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.log("p")).alias("x"), F.var_pop(F.log("p")).alias("v"))
    found = [(r.n, r.x, r.v or 0.0) for r in bins.orderBy("bin").collect()]

    def at(a: float) -> tuple[float, float, float]:
        # A bin's sum of e^(ax) about its mean x, to the second order in its width.
        z = math.fsum(n * math.exp(a * x) * (1 + a * a * v / 2) for n, x, v in found)
        zl = math.fsum(n * math.exp(a * x) * (x * (1 + a * a * v / 2) + a * v) for n, x, v in found)
        return z, zl, math.exp((1 - a) * (high - low))

    return at


def find_exponent(shares: DataFrame, max_repetition: float | None = None, target_entropy: float | None = None) -> float:
    """Bisects the exponent over a table of shares p > 0."""
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give max_repetition or target_entropy")
    at = _moments(shares)

    def fits(a: float) -> bool:
        z, zl, ratio = at(a)
        if max_repetition is not None:
            return ratio > max_repetition  # then the exponent must rise
        return math.log(z) - a * zl / z > target_entropy

    low, high = 0.0, 1.0
    if not fits(low):
        return low
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return high


def units_of(docs: DataFrame, id_col: str, source_col: str, text_col: str, tokens: Column | None) -> DataFrame:
    """One row per set of rows alike in id, source and text: id, source, unit, tokens (of all of them)."""
    unit = F.xxhash64(F.col(id_col).cast("long"), F.col(source_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), unit.alias("unit"), (word_count(F.col(text_col)) if tokens is None else tokens.cast("long")).alias("tokens"))
    return rows.groupBy("id", "source", "unit").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def mix_units(units: DataFrame, max_repetition: float | None = None, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = 1 << 20, seed: str = "mix") -> DataFrame:
    """One row per copy of a unit: id, source, unit, tokens, weight, epoch, block."""
    units = materialise(units, "mix-units")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sums = materialise(units.groupBy(key.alias("key")).agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")), "mix-sources")
    total = sums.agg(F.sum("n")).first()[0] or 0
    if not total:
        return units.withColumns({"weight": F.lit(0.0), "epoch": F.lit(0).cast("long"), "block": F.lit(0).cast("long")})
    shares = sums.filter("n > 0").select("key", "n", "rows", (F.col("n") / F.lit(float(total))).alias("p"))
    a = find_exponent(shares, max_repetition, target_entropy)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    weighted = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    if budget is None:
        budget = weighted.agg(F.max(F.col("n") / F.col("weight"))).first()[0]
    plan = sums.select("key", "n", "rows").join(weighted.select("key", "weight"), "key", "left").select(
        "key",
        F.col("n").alias("source_tokens"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        (F.coalesce("weight", F.lit(0.0)) * F.lit(float(budget))).alias("source_budget"),
        F.ceil(F.col("rows") / RANGE_ROWS).cast("long").alias("ranges"),
    )
    # Rounding must not cut the last token of a budget that is a whole number of epochs.
    full = F.when(F.col("source_tokens") > 0, F.floor(F.col("source_budget") / F.col("source_tokens") + 1e-9)).otherwise(1)
    plan = materialise(plan.withColumn("full", full.cast("long")).withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("source_budget") - F.col("full") * F.col("source_tokens")) + 1e-6).cast("long")), "mix-plan")
    joined = units.withColumn("key", key).join(plan, "key")
    copies = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    copies = copies.withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    copies = copies.withColumn("range", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)).cast("long"))
    by_range = copies.groupBy("key", "epoch", "range").agg(F.sum("tokens").alias("in_range"))
    earlier = F.sum("in_range").over(Window.partitionBy("key", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_range.select("key", "epoch", "range", F.coalesce(earlier, F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("key", "epoch", "range").orderBy("order", "id", "unit")
    upto = F.col("range_start") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = copies.join(starts, ["key", "epoch", "range"]).withColumn("upto", upto)
    kept = placed.filter((F.col("epoch") < F.col("full")) | ((F.col("upto") <= F.col("rest")) & (F.col("tokens") > 0)))
    place = F.when(F.col("source_budget") > 0, (F.col("epoch") * F.col("source_tokens") + F.col("upto") - F.col("tokens")) / F.col("source_budget")).otherwise(0.0)
    blocks = max(1, math.ceil(budget / block_tokens))
    return kept.select("id", "source", "unit", "tokens", "weight", "epoch", F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("long").alias("block"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, **options) -> DataFrame:
    """The documents of the mixture, a row for each copy, with the input's columns."""
    copies = mix_units(units_of(docs, id_col, source_col, text_col, tokens), **options)
    times = copies.groupBy("unit").agg(F.count("*").alias("times"))
    unit = F.xxhash64(F.col(id_col).cast("long"), F.col(source_col), F.col(text_col))
    # The row travels as one column, so that none of its own can clash.
    mixed = docs.select(unit.alias("unit"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")).join(times, "unit")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


MAX_REPETITION = 2.0


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents' sources: a row for each copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = mix_units(units_of(docs, "doc_id", "source", "text", None), max_repetition=MAX_REPETITION)
    return copies.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "epoch", "block")


OP9_SQL = f"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS sn FROM t GROUP BY source),
p AS (SELECT source, sn, sn / sum(sn) OVER () AS p FROM s),
a AS (SELECT CASE WHEN max(p) / min(p) > {MAX_REPETITION} THEN 1 - ln({MAX_REPETITION}) / ln(max(p) / min(p)) ELSE 0 END AS a FROM p),
w AS (SELECT source, sn, pow(p, a) / sum(pow(p, a)) OVER () AS w FROM p, a),
b AS (SELECT source, sn, w, max(sn / w) OVER () AS budget FROM w),
q AS (SELECT source, sn, w * budget AS sb, budget, floor(w * budget / sn + 1e-9)::BIGINT AS full_epochs FROM b),
r AS (SELECT *, floor(greatest(0, sb - full_epochs * sn) + 1e-6)::BIGINT AS rest FROM q),
c AS (SELECT t.doc_id, t.source, t.n, r.*, unnest(generate_series(0, r.full_epochs)) AS epoch FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source),
o AS (SELECT *, sum(n) OVER (PARTITION BY source, epoch ORDER BY md5(concat_ws('|', 'mix', epoch::VARCHAR, doc_id::VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT doc_id, source, n AS n_tokens, epoch::BIGINT AS epoch,
       least(floor((epoch * sn + upto - n) / sb * greatest(1, ceil(budget / 1048576))), greatest(1, ceil(budget / 1048576)) - 1)::BIGINT AS block
FROM o WHERE epoch < full_epochs OR (upto <= rest AND n > 0)
"""
