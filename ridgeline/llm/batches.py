"""Rows with whole texts on their way to and from Python, a few megabytes at a time.

Spark's batches have 10,000 rows whatever their length: of texts some 30 MB, which are in the
JVM twice while a buffer grows, and in the worker as a batch and as strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows with a text that are taken at once.
ROWS = 1000

_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which share the memory of those they are of."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keep_batches_small(spark: SparkSession) -> str:
    """From now on the session's batches have at most ``ROWS`` rows; returns the setting that held before."""
    before = spark.conf.get(_RECORDS)
    if not 0 < int(before) <= ROWS:
        spark.conf.set(_RECORDS, str(ROWS))
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within gets at most ``ROWS`` rows a batch; the session's setting is put back."""
    before = keep_batches_small(spark)
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)
