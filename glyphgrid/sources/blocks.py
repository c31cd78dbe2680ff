"""Volumes as block rows: the physical form of large data, of which pixel rows are a view.

A block is one square of one layer, as bytes in row order. Files are partitioned by segment and sorted by layer and
place, so that a read of some layers or a window prunes folders, files and row groups before a byte is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seg_id string, z int, by int, bx int, h int, w int, data binary"


def to_blocks(vox: DataFrame, size: int = 256) -> DataFrame:
    """Block rows of (seg_id, z, y, x, v) with v in 0..255; cells without a row are 0. A block is as high and wide as its cells need."""
    place = vox.select("seg_id", "z", "y", "x", F.col("v").cast("int").alias("v"), F.floor(F.col("y") / size).cast("int").alias("by"), F.floor(F.col("x") / size).cast("int").alias("bx"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy() - key[2] * size, pdf["x"].to_numpy() - key[3] * size
        img = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
        img[y, x] = pdf["v"]
        return pd.DataFrame({"seg_id": [key[0]], "z": [key[1]], "by": [key[2]], "bx": [key[3]], "h": [img.shape[0]], "w": [img.shape[1]], "data": [img.tobytes()]})

    return place.groupBy("seg_id", "z", "by", "bx").applyInPandas(run, SCHEMA)


def write_blocks(blocks: DataFrame, path: str, mode: str = "append") -> None:
    blocks.repartition("seg_id", "z").sortWithinPartitions("seg_id", "z", "by", "bx").write.mode(mode).option("compression", "zstd").partitionBy("seg_id").parquet(path)


def read_blocks(spark: SparkSession, path: str, *, segments: list[str] | None = None, z: tuple[int, int] | None = None, window: tuple[int, int, int, int] | None = None, size: int = 256) -> DataFrame:
    """Block rows of some segments, of layers [first, last) and of the blocks that meet a window (y0, y1, x0, x1)."""
    b = spark.read.schema(SCHEMA).parquet(path)
    if segments is not None:
        b = b.where(F.col("seg_id").isin(segments))
    if z is not None:
        b = b.where((F.col("z") >= z[0]) & (F.col("z") < z[1]))
    if window is not None:
        y0, y1, x0, x1 = window
        b = b.where((F.col("by") >= y0 // size) & (F.col("by") <= (y1 - 1) // size) & (F.col("bx") >= x0 // size) & (F.col("bx") <= (x1 - 1) // size))
    return b


def pixels(blocks: DataFrame, size: int = 256, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(seg_id, z, y, x, v) of block rows, cut to a window if given; one block at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"])
                y, x = (i.ravel() for i in np.indices(v.shape, np.int32))
                y, x, v = y + np.int32(r["by"] * size), x + np.int32(r["bx"] * size), v.ravel().astype(np.int32)
                if window is not None:
                    keep = (y >= window[0]) & (y < window[1]) & (x >= window[2]) & (x < window[3])
                    y, x, v = y[keep], x[keep], v[keep]
                n = len(v)
                yield pa.RecordBatch.from_arrays([pa.array([r["seg_id"]] * n), pa.array(np.full(n, r["z"], np.int32)), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(v)], names=["seg_id", "z", "y", "x", "v"])

    return blocks.mapInArrow(run, "seg_id string, z int, y int, x int, v int")


def block_layer_stats(blocks: DataFrame) -> DataFrame:
    """Count, mean, deviation and range of each layer, summed block by block without making pixel rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            v = [np.frombuffer(d, np.uint8).astype(np.float64) for d in p["data"]]
            yield pd.DataFrame({"seg_id": p["seg_id"], "z": p["z"], "n": [len(x) for x in v], "s": [x.sum() for x in v], "q": [(x * x).sum() for x in v], "lo": [int(x.min()) for x in v], "hi": [int(x.max()) for x in v]})

    sums = blocks.mapInPandas(run, "seg_id string, z int, n long, s double, q double, lo int, hi int").groupBy("seg_id", "z").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mean = F.col("s") / F.col("n")
    return sums.select("seg_id", "z", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "lo", "hi")
