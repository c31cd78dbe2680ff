"""Images of maps of any size: strips that are compressed apart, whose places in the file a prefix sum gives.

A strip is one row of blocks. Tasks compress strips; nothing larger is ever in one place: the pieces of a file (head, strips,
directory) are rows with their offsets, and a file is written by appending them in order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Tags of a greyscale image of bytes in deflated strips, in the order that a file must have them: (tag, kind), 3 for short, 4 for long.
_TAGS = ((256, 4), (257, 4), (258, 3), (259, 3), (262, 3), (273, 4), (277, 3), (278, 4), (279, 4))
_STRIP = "seg_id string, strip int, h int, w int, data binary"


def strips(blocks: DataFrame, size: int) -> DataFrame:
    """(seg_id, strip, h, w, data): rows of blocks (MAP_SCHEMA, doubles in [0, 1]) as deflated bytes, cut to whole numbers."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        seg_id, by = (k.as_py() for k in key)
        parts = sorted(t.to_pylist(), key=lambda r: r["bx"])
        img = np.concatenate([np.frombuffer(r["data"], "f8").reshape(r["h"], r["w"]) for r in parts], axis=1)
        data = zlib.compress((img * 255).astype(np.uint8).tobytes())
        return pa.table({"seg_id": [seg_id], "strip": pa.array([by], pa.int32()), "h": pa.array([img.shape[0]], pa.int32()), "w": pa.array([img.shape[1]], pa.int32()), "data": pa.array([data], pa.binary())})

    return blocks.select("seg_id", "by", "bx", "h", "w", "data").groupBy("seg_id", "by").applyInArrow(run, _STRIP)


def tiff_pieces(blocks: DataFrame, size: int) -> DataFrame:
    """(seg_id, piece, offset, data): the bytes of one TIFF a segment, in pieces: the head, each strip, and the directory behind them.
    The directory holds a place and a length for each strip, never a pixel."""
    s = written(strips(blocks, size), "strips")
    before = W.partitionBy("seg_id").orderBy("strip").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("length", F.octet_length("data").cast("long"))
    # without the data, so that the prefix sum sorts numbers only
    place = s.select("seg_id", "strip", "length", "h", "w", (F.lit(8) + F.coalesce(F.sum("length").over(before), F.lit(0))).cast("long").alias("offset"))
    place = written(place, "offsets")
    file = place.groupBy("seg_id").agg(F.max(F.col("offset") + F.col("length")).alias("end"), F.sum("h").cast("int").alias("h"), F.max("w").alias("w"), F.array_sort(F.collect_list(F.struct("strip", "offset", "length"))).alias("strips"))

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, end = len(r["strips"]), r["end"] + r["end"] % 2  # a directory begins at an even place
                if end + 20 * n > 0xFFFFFFFF:
                    raise ValueError(f"the image of {r['seg_id']} is larger than its format allows")
                values = {256: r["w"], 257: r["h"], 258: 8, 259: 8, 262: 1, 277: 1, 278: size}
                lists = {273: [x["offset"] for x in r["strips"]], 279: [x["length"] for x in r["strips"]]}
                at = end + 2 + 12 * len(_TAGS) + 4
                where = {273: at, 279: at + 4 * n}
                out = struct.pack("<H", len(_TAGS))
                for tag, kind in _TAGS:
                    many = tag in lists
                    value = values.get(tag) if not many else lists[tag][0] if n == 1 else where[tag]
                    out += struct.pack("<HHI", tag, kind, n if many else 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
                out += struct.pack("<I", 0) + (b"".join(struct.pack(f"<{n}I", *lists[k]) for k in (273, 279)) if n > 1 else b"")
                data = [b"II" + struct.pack("<HI", 42, end), bytes(end - r["end"]) + out]
                yield pa.RecordBatch.from_arrays([pa.array([r["seg_id"]] * 2), pa.array([-1, n], pa.int32()), pa.array([0, r["end"]], pa.int64()), pa.array(data, pa.binary())], names=["seg_id", "piece", "offset", "data"])

    frames = file.mapInArrow(frame, "seg_id string, piece int, offset long, data binary")
    own = place.select(F.col("seg_id").alias("_seg"), F.col("strip").alias("_strip"), "offset")
    body = s.join(own, (F.col("seg_id") == F.col("_seg")) & (F.col("strip") == F.col("_strip"))).select("seg_id", F.col("strip").alias("piece"), "offset", "data")
    return frames.unionByName(body)


def write_files(pieces: DataFrame, path: str, end: str = "tif") -> DataFrame:
    """Writes one file a segment, `path`/segment.tif, by appending its pieces in order; a piece is in memory at a time. Returns
    (seg_id, path, length)."""
    from .layers import _store

    together = pieces.repartition("seg_id").sortWithinPartitions("seg_id", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        at, out, length = None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{root}/{at}.{end}.part", f"{root}/{at}.{end}")
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([f"{root}/{at}.{end}"]), pa.array([length], pa.int64())], names=["seg_id", "path", "length"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["seg_id"] != at:
                    if at is not None:
                        yield close()
                    at, length = r["seg_id"], 0
                    out = store.open_output_stream(f"{root}/{at}.{end}.part")
                if r["offset"] != length:
                    raise ValueError(f"a piece of {at} is missing before {r['offset']}")
                out.write(r["data"])
                length += len(r["data"])
        if at is not None:
            yield close()

    return together.mapInArrow(write, "seg_id string, path string, length long")
