"""URL filter: rules on host and path first, then logistic regression.

A rule (verdict, host, path) fits its host and all subdomains where the url's path
starts with the rule's path; of those that fit, the longest wins. A url that no rule
fits is judged by logistic regression on hashed character n-grams of host and path,
trained from a small table of labelled urls. All of it are DataFrame operations and
Spark's own feature hashing and regression. No table of labels for urls is given, so a
small one is made of words: kinds of sites that blocklists name, and ordinary subjects,
none of them taken from a table that is judged. A site that none of its words' n-grams
names is mostly allowed: README has the accuracy on subjects it hasn't seen. ``train``
takes any other table.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased; the path goes on up to ``?``, ``#`` or the end. A null url or one
without ``://`` has an empty host and path; with no n-gram to judge, it is allowed.
Repeated rows are judged alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.native import ascii_lower
from ridgeline.storage import scratch

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Subjects of sites to be blocked, by kind, and of ordinary ones.
_BLOCKED = {
    "gambling": "poker roulette slots jackpot betting blackjack lottery bingo wager bookmaker baccarat gamble",
    "adult": "xxx porn cams escorts nude erotic sexchat webcam milf hentai stripper hookup",
    "pharma": "pharma viagra cialis steroids tramadol painkiller pharmacy meds",
    "advertising": "adserver doubleclick banners popup clicks affiliate remarketing pixel analytics telemetry impressions sponsor",
    "spam": "backlinks seo linkfarm bulkmail followers giveaway getrich spammer",
    "loans": "loans payday creditfix quickcash debt forex cryptoprofit binary-options",
    "abuse": "phishing warez keygen crack torrent malware botnet replica",
}
_ORDINARY = """museum library garden weather history theatre bakery station school recipes travel earth science mountain cathedral health river forest music
poetry football cooking knitting railway harbour village council church hospital university physics chemistry biology letters culture orchard sailing cycling hiking
camera pottery authors sister children lighthouse education tradition exhibition nutrition translation foundation harvest market news journal review magazine gallery
studio academy institute society club energy climate animals birds flowers kitchen furniture design fashion cinema radio podcast software developer database network
engine bridge tunnel airport hotel island beach winter summer family parents teacher student law justice parliament election policy budget tax insurance bank
economy industry steel paper textile ocean planet galaxy atom protein vaccine clinic dentist""".split()
_AFFIXES = ("my", "top", "city", "daily", "open", "great", "hub", "zone", "world", "24")


def subjects() -> tuple[list[str], list[str]]:
    """Those to be blocked and the ordinary ones."""
    return [w for words in _BLOCKED.values() for w in words.split()], _ORDINARY


def host_names(subjects: Sequence[str], affixes: Sequence[str]) -> list[str]:
    """Each subject before and after some of the affixes, with and without a hyphen."""
    return [(f"{x}-{s}", f"{s}-{x}", f"{s}{x}", f"{x}{s}")[(i + j) % 4] for i, s in enumerate(subjects) for j, x in enumerate(affixes) if (i + j) % 3 != 1]


def labelled_urls(affixes: Sequence[str] = _AFFIXES, part: int | None = None) -> list[tuple[str, int]]:
    """The labelled table, 1 to be blocked: affixes, subdomains, domains and paths are alike for both labels.

    With ``part`` 0 or 1, every second subject.
    """
    rows = []
    for label, names in zip((1, 0), subjects(), strict=True):
        for i, name in enumerate(host_names(names if part is None else names[part::2], affixes)):
            sub, tld, lang = ("", "www.", "m.", "blog.")[i % 4], ("com", "net", "org")[i % 3], ("en", "de", "fr", "es")[i // 2 % 4]
            rows.append((f"https://{sub}{name}.example.{tld}/{lang}/{i * 197 % 9973}{('', '/', '.html')[i // 3 % 3]}", label))
    return rows


NGRAMS = (3, 4, 5)
BUCKETS = 1 << 15


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host|path$``; none where both are empty."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def each(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(F.concat(*[each(n) for n in NGRAMS]))


def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True).transform(df)


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] | None = None) -> LogisticRegressionModel:
    """Fits the labelled table, which is small by contract and stays in one partition.

    The model is saved and loaded: a model just fitted holds its training's session, which no task can get.
    """
    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in labelled or labelled_urls()])))
    rows = _hashed(table.select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams")))
    folder = scratch(spark, "url-model")
    LogisticRegression(regParam=0.001, maxIter=60, standardization=False).fit(rows).save(folder)
    return LogisticRegressionModel.load(folder)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (probability to be blocked)."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    scored = model.transform(_hashed(rows.withColumn("grams", grams(F.col("host"), F.col("path")))))
    score = F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(vector_to_array("probability")[1])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = scored.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return out.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(spark)).withColumnRenamed("id", "page_id")
