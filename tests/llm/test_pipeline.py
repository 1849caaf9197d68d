"""The pipeline against its stages in plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as cp
from ridgeline.llm.decontaminate import words_of
from tests.llm.test_near_dedup import brute as near_groups
from tests.llm.test_near_dedup import family
from tests.llm.test_tokens_language_mixing import brute_mix

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(900)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = {k: " ".join(prose(30)) for k in range(8)}
    docs = {}

    def put(text, source=None):
        docs[len(docs)] = (text, source if source is not None else rng.choice(["a", "a", "a", "b", "c"]))

    for k in range(60):
        put(" ".join(prose(rng.randint(20, 120))))
    for t in family(rng, prose(100), 12, 3) + ["Same text of ten words that is here many times over"] * 9:
        put(t)
    for k in items:
        put(" ".join(prose(15)) + " " + items[k].title() + ". " + " ".join(prose(10)))
    for t in (None, "", "12 34 !", "  "):
        put(t)
    docs[len(docs)] = (" ".join(prose(40)), None)
    return docs, items


def write(spark, folder, docs, items):
    spark.createDataFrame([(d, t, "en", s, 0) for d, (t, s) in docs.items()], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, items = corpus()
    write(spark, str(tmp_path), docs, items)
    left = {d: v for d, v in docs.items() if v[0] and any(map(str.isalpha, v[0]))}
    groups = near_groups([(d, t) for d, (t, _) in left.items()], 0.8)
    left = {d: v for d, v in left.items() if groups[d][1] == d}
    joined = lambda t: b" " + b" ".join(words_of(t)) + b" "
    left = {d: v for d, v in left.items() if not any(joined(x) in joined(v[0]) for x in items.values())}
    copies = brute_mix({d: (s, len(t.split())) for d, (t, s) in left.items()}, cp.MAX_REPETITION)
    tokenizer, want, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), [], 0
    for d in sorted(left):
        ids = np.array(tokenizer.encode(left[d][0], add_special_tokens=False).ids + [2], "<u4")
        for _ in range(copies[d]):
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    got = sorted(map(tuple, cp.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want
    assert any(n > 1 for n in copies.values())


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    docs, items = corpus()
    write(spark, str(tmp_path), {} if empty == "documents" else docs, {} if empty == "benchmark" else items)
    rows = cp.run(spark, str(tmp_path)).collect()
    assert len(rows) == 0 if empty == "documents" else len(rows) > 60


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name


def test_repeated_ids_clashing_columns_and_long_texts(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(60_000)
    texts = [(1, prose(40)), (1, prose(50)), (1, None), (2, long), (None, prose(30)), (None, prose(35)), (3, "12 !")]
    texts += [texts[0], texts[4]]  # alike in id and text
    texts += [(4, prose(20) + " the item stands here as it is " + prose(5))]
    rows = [(d, t, "en", "s", 0, f"p{i}", 0.5, "u", i) for i, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS + ", lang_pred string, score double, _key string, unit long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the item stands here as it is")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*(c.split()[0] for c in COLUMNS.split(", ")), "lang_pred", "score", "_key", "unit"]
    left = [(r.doc_id, r.text, r.lang_pred) for r in docs.collect()]
    assert sorted((d, t) for d, t, _ in left if d is not None) == sorted([texts[0], texts[1], texts[3]])
    assert sorted(t for d, t, _ in left if d is None) == sorted([texts[4][1], texts[5][1]])
    assert all(p in {f"p{i}" for i, x in enumerate(texts) if x == (d, t)} for d, t, p in left)
    assert len(cp.run(spark, str(tmp_path)).collect()) == 5
    unlabelled = spark.createDataFrame([(d, t, None, "s", 0) for d, t in texts], COLUMNS)
    assert cp.language(spark, unlabelled, "").count() == 8
