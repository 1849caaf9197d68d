"""Tables that cut lineage: written once to the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder. Where it is unset (local tests) a
temporary folder of this machine is taken, which only local mode may use.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI or path, without a trailing slash."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/ridgeline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result survives lost executors and has no lineage but the scan.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates of the table, read from the columns that they need."""
    table = materialise(df, name)
    return table, table.agg(*[c.alias(k) for k, c in measures.items()]).first().asDict()


#: Bytes that a task should get of what is dealt out by key.
TASK_BYTES = 64 << 20


def enough(spark: SparkSession, size: float) -> int:
    """Partitions for ``size`` bytes: adaptive execution lowers their number and never raises it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / TASK_BYTES) + 1)


def in_groups(df: DataFrame, column: str, size: float) -> DataFrame:
    """Deals about ``size`` bytes of rows out by ``column`` and brings equal ones next to each other."""
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = enough(df.sparkSession, size)
    return (df.repartition(parts, column) if parts > default else df.repartition(column)).sortWithinPartitions(column)


@contextmanager
def bucketed(df: DataFrame, name: str, column: str, size: float) -> Iterator[DataFrame]:
    """Writes about ``size`` bytes as a table in buckets of a column, in the shared folder: joins on it move only the other side.

    The catalogue knows the table while the context lasts.
    """
    spark = df.sparkSession
    parts, table = enough(spark, size), f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, column).write.bucketBy(parts, column).option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
