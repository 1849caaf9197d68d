"""Points that arrive as files, kept as a surface grid that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.grid import GridMeta
from ridgeline.operators.points import highest


def point_stream(spark: SparkSession, folder: str, schema: str = "x double, y double, z float") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def keep_surface(points: DataFrame, meta: GridMeta, ymin: float, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changed cells of each batch under its number; the last batch of a cell holds.

    State is one value a cell, whatever the number of points.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return highest(points, meta, ymin).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def surface(spark: SparkSession, path: str) -> DataFrame:
    """The grid as the batches so far leave it."""
    return spark.read.parquet(path).groupBy("r", "c").agg(F.max_by("z", "batch").alias("z"))
