"""Whole texts reach Python a thousand rows at a time."""

import pyarrow as pa
import pytest

import corpus_pipeline
from ridgeline.llm import batches

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def setting(spark):
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, "10000")
    yield
    spark.conf.set(SETTING, before)


def rows_at_once(docs):
    def count(found):
        for batch in found:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32())})

    return [r.n for r in docs.mapInArrow(count, "n int").collect()]


def test_slices_have_all_rows():
    whole = [pa.RecordBatch.from_pydict({"id": list(range(n)), "text": [str(k) for k in range(n)]}) for n in (0, 1, 7, 10)]
    parts = list(batches.in_slices(whole, 3))
    assert max(p.num_rows for p in parts) == 3
    assert [r for p in parts for r in p.to_pylist()] == [r for b in whole for r in b.to_pylist()]


def test_setting_is_put_back(spark, setting):
    docs = spark.range(0, 3500, 1, 1)
    assert max(rows_at_once(docs)) > batches.ROWS
    with pytest.raises(ZeroDivisionError), batches.small_batches(spark):
        got = rows_at_once(docs)
        assert max(got) <= batches.ROWS and sum(got) == 3500
        raise ZeroDivisionError
    assert spark.conf.get(SETTING) == "10000"
    spark.conf.set(SETTING, "50")
    with batches.small_batches(spark):
        assert spark.conf.get(SETTING) == "50"


def test_pipeline_keeps_batches_small(spark, setting):
    docs = spark.createDataFrame([(k, "some words of a text", "en") for k in range(2500)], "doc_id long, text string, lang string").coalesce(1)
    kept = corpus_pipeline.language(spark, docs, "")
    got = rows_at_once(kept)
    assert max(got) <= batches.ROWS and sum(got) == 2500
