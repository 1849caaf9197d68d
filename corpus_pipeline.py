"""The corpus pipeline: raw documents to token files, stage by stage.

Each stage takes what its predecessor kept, whole, and its decisions take effect. All
but the last return the columns of ``documents``. Null texts and texts without a letter
leave in the first stage. Rows that repeat an id with another text are documents of their
own in every stage; rows alike in both are one from the second on. Texts are read whole,
however long, and other columns travel with their rows, whatever their names. An empty
table gives no token. From the first stage on the session's Arrow batches have a thousand
rows at most (``keep_batches_small``): a lazy table can't put a setting back. The operators' docstrings state their other rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.batches import keep_batches_small
from ridgeline.llm.decontaminate import drop_contaminated
from ridgeline.llm.language_id import train, with_language
from ridgeline.llm.mixing import MAX_REPETITION, mix_documents
from ridgeline.llm.near_dedup import keep_one
from ridgeline.llm.token_output import tokens_of
from ridgeline.storage import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, by mixture inference learned from the labelled ones; all with a letter where none is labelled."""
    # The stage's rows go to Python when it is written, by whoever takes it.
    keep_batches_small(spark)
    model = train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # Numbered names can't clash with those that the operator adds.
    names = [f"c{k}" for k in range(len(docs.columns))]
    judged = with_language(docs.toDF(*names), model, text_col=names[docs.columns.index("text")])
    return judged.filter("lang_pred <> 'und'").select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return keep_one(docs, 0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights: every document once at least, a row for each copy."""
    return mix_documents(docs, max_repetition=MAX_REPETITION)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: each copy's place, length and checksum."""
    import public_tokenizers

    return tokens_of(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token-ID output", tokens),
]

#: Language mixtures, latent retrieval and the tokenizer have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
