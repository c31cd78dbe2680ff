"""Layers that arrive over time: statistics and refinement of each new batch. An extension; the batch operators are the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PIXELS = "seg_id string, z int, y int, x int, v int, arrived timestamp"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Pixels of Parquet files as they appear in a folder."""
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def layer_counts(pixels: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Pixels and mean value of each segment and window of arrival; rows later than `late` are left out."""
    return pixels.withWatermark("arrived", late).groupBy(F.window("arrived", window), "seg_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def each_batch(pixels: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands what has arrived to `work`, such as a refinement of its segments, until the folder is read."""
    return pixels.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
