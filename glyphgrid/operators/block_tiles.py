"""Sliding-window inference on block rows: whatever is shuffled is bytes of parts of tiles, never a row for each voxel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tiles import tile_numbers

MAP_SCHEMA = "seg_id string, by int, bx int, h int, w int, data binary"
_PIECE = "seg_id string, ty int, tx int, z int, layers int, iy int, ix int, h int, w int, data binary"
_PART = "seg_id string, by int, bx int, iy int, ix int, h int, w int, data binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def tile_pieces(blocks: DataFrame, tile: int, stride: int, size: int = 256) -> DataFrame:
    """Block rows cut to the tiles that they meet: a tile's corner, the layer counted from the first, the number of layers, the
    place within the tile, and the bytes. Parts that are all 0 have no row."""
    b = blocks.withColumns({"y": F.col("by") * size, "x": F.col("bx") * size})
    e = b.groupBy("seg_id").agg(F.max(F.col("y") + F.col("h")).alias("eh"), F.max(F.col("x") + F.col("w")).alias("ew"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    met = lambda c, end, n: tile_numbers(F.col(c), F.col(end), tile, stride, F.col(c) + F.col(n) - 1)
    b = b.join(e, "seg_id").select("seg_id", (F.col("z") - F.col("z0")).alias("z"), (F.col("z1") - F.col("z0") + 1).alias("layers"), "y", "x", "h", "w", "data", met("y", "eh", "h").alias("tys"), met("x", "ew", "w").alias("txs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r, out = batch.slice(i, 1).to_pylist()[0], []
                img = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"])
                for ty in r["tys"]:
                    for tx in r["txs"]:
                        top, left = ty * stride - r["y"], tx * stride - r["x"]
                        part = img[max(top, 0) : top + tile, max(left, 0) : left + tile]
                        if part.any():
                            out.append((r["seg_id"], ty * stride, tx * stride, r["z"], r["layers"], max(-top, 0), max(-left, 0), *part.shape, part.tobytes()))
                yield from _table(out, _PIECE).to_batches()

    return b.where((F.size("tys") > 0) & (F.size("txs") > 0)).mapInArrow(cut, _PIECE)


class PatchRows:
    """Table function: pieces of tiles to one row a tile, its values scaled to [0, 1] in order z, y, x. Called over
    `TABLE(pieces) PARTITION BY (seg_id, ty, tx)`, where pieces are `tile_pieces`, with the tile's side. A tile is in memory at a
    time, as bytes."""

    @staticmethod
    def analyze(pieces, tile):
        from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructType
        from pyspark.sql.udtf import AnalyzeResult

        if not pieces.isTable or not tile.isConstantExpression:
            raise ValueError("patch_rows takes a table of pieces and a constant side")
        missing = {f.split()[0] for f in _PIECE.split(", ")} - set(pieces.dataType.names)
        if missing:
            raise ValueError(f"patch_rows needs the columns {sorted(missing)}")
        schema = StructType().add("seg_id", StringType()).add("ty", IntegerType()).add("tx", IntegerType()).add("layers", IntegerType()).add("img", ArrayType(FloatType(), containsNull=False))
        return AnalyzeResult(schema)

    def __init__(self):
        self.key, self.img = None, None

    def eval(self, r, tile):
        if self.img is None:
            self.key, self.img = (r["seg_id"], r["ty"], r["tx"], r["layers"]), np.zeros((r["layers"], tile, tile), np.uint8)
        self.img[r["z"], r["iy"] : r["iy"] + r["h"], r["ix"] : r["ix"] + r["w"]] = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"])

    def terminate(self):
        if self.img is not None:
            yield *self.key, (self.img.ravel() / 255.0).tolist()


def register_functions(spark: SparkSession) -> None:
    """Makes `patch_rows` known to SQL."""
    spark.udtf.register("patch_rows", F.udtf(PatchRows))


def predict_blocks(blocks: DataFrame, load: Callable[[], Callable], tile: int, stride: int, size: int = 256) -> DataFrame:
    """Block rows of the map (MAP_SCHEMA, 32-bit floats) that a model predicts from block rows of a volume: the mean over the
    tiles that cover a pixel, 0 where all layers are 0. Equal to `tiles.predict_segment` on the volume's voxels but for the
    precision.

    load: called once in each task; gives a function from (1, z, y, x), scaled to [0, 1], to (1, y, x). Cells without a row,
    of the volume as of the map, are 0; the rest that no tile covers has no row. One tile is in memory at a time.
    """
    held: list[Callable] = []

    def predict(key: tuple, pieces: pa.Table) -> pa.Table:
        if not held:
            held.append(load())
        seg_id, ty, tx = (k.as_py() for k in key)
        img = np.zeros((pieces["layers"][0].as_py(), tile, tile), np.uint8)
        for r in pieces.select(["z", "iy", "ix", "h", "w", "data"]).to_pylist():
            img[r["z"], r["iy"] : r["iy"] + r["h"], r["ix"] : r["ix"] + r["w"]] = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"])
        p = np.asarray(held[0](img[None].astype(np.float32) / 255.0)).reshape(tile, tile)
        p = np.where(img.any(axis=0), p, 0).astype(np.float32)
        out = []
        for by in range(ty // size, (ty + tile - 1) // size + 1):
            for bx in range(tx // size, (tx + tile - 1) // size + 1):
                y, x = max(ty, by * size), max(tx, bx * size)
                part = p[y - ty : (by + 1) * size - ty, x - tx : (bx + 1) * size - tx]
                out.append((seg_id, by, bx, y - by * size, x - bx * size, *part.shape, part.tobytes()))
        return _table(out, _PART)

    def average(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, h, w = np.zeros((size, size)), np.zeros((size, size), np.int32), 0, 0
        for batch in parts:
            for r in batch.select(["iy", "ix", "h", "w", "data"]).to_pylist():
                at = (slice(r["iy"], r["iy"] + r["h"]), slice(r["ix"], r["ix"] + r["w"]))
                total[at] += np.frombuffer(r["data"], np.float32).reshape(r["h"], r["w"])
                n[at] += 1
                h, w = max(h, at[0].stop), max(w, at[1].stop)
        p = (total / np.maximum(n, 1))[:h, :w].astype(np.float32)
        yield from _table([(*(k.as_py() for k in key), h, w, p.tobytes())], MAP_SCHEMA).to_batches()

    predicted = tile_pieces(blocks, tile, stride, size).groupBy("seg_id", "ty", "tx").applyInArrow(predict, _PART)
    return predicted.groupBy("seg_id", "by", "bx").applyInArrow(average, MAP_SCHEMA)


def map_pixels(blocks: DataFrame, size: int = 256) -> DataFrame:
    """(seg_id, y, x, p) of the block rows of a map, without zeros; one block at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                p = np.frombuffer(r["data"], np.float32).reshape(r["h"], r["w"])
                y, x = np.nonzero(p)
                columns = [pa.array([r["seg_id"]] * len(y), pa.string()), pa.array(y + r["by"] * size, pa.int32()), pa.array(x + r["bx"] * size, pa.int32()), pa.array(p[y, x].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["seg_id", "y", "x", "p"])

    return blocks.mapInArrow(run, "seg_id string, y int, x int, p double")
