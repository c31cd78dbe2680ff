"""Layer files as a data source, for batches and streams: `spark.read.format("layers")`, `spark.readStream.format("layers")`.

Folders hold a segment each, its layers in files named by their number. The driver lists files and reads heads of files; a
task reads the byte range of some rows of one file, where the format allows it (NumPy arrays, TIFF strips), else the
file. Conditions on `seg_id` and `z` choose files before one is opened. A stream keeps a log of the files that it has admitted, beside
its checkpoint: an offset is a number of log entries, so that a file is delivered once, whatever comes or restarts meanwhile.

Options: `path`, the folder, of any store that Arrow's file systems know; `rangeBytes`, the bytes of a task's range, about;
`pattern`, what file names end with; for streams `log`, the folder of the log, and `filesPerBatch`, the files of one
entry at most.
"""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import raster

SCHEMA = "seg_id string, z int, y int, x int, v int"
_HEAD = 1 << 16
_NAME = re.compile(r"([^/]+)/(?:layers/|surface_volume/)?(\d+)\.[A-Za-z]+$")
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class RowRange(InputPartition):
    """Rows [y, y + h) of a layer: bytes [start, start + length) of its file in rows of `w` values of a kind; without a kind the
    whole file, for the decoder."""

    path: str
    seg_id: str
    z: int
    start: int = 0
    length: int = 0
    y: int = 0
    h: int = 0
    w: int = 0
    kind: str = ""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_layers(path: str, pattern: str = "") -> list[tuple[str, str, int, int]]:
    """(path, segment, layer, bytes) of the layer files under a folder, in order."""
    store, root = _store(path)
    found = []
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = _NAME.search(f.path)
        if f.type == fs.FileType.File and name and f.path.endswith(pattern):
            found.append((f.path, name[1], int(name[2]), f.size))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def _plain_rows(head: bytes) -> tuple[int, int, int, str] | None:
    """(start, rows, columns, kind) of the values that a file holds as they are, row after row; None if it doesn't."""
    try:
        if head[:6] == b"\x93NUMPY":
            f = io.BytesIO(head)
            version = np.lib.format.read_magic(f)
            shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            return (f.tell(), *shape, dtype.str) if len(shape) == 2 and not by_columns else None
        tags, order = raster.tiff_tags(head)
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            return None
        kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}[tags.get(258, (1,))[0], tags.get(339, (1,))[0]]
        h, w, starts, lengths = tags[257][0], tags[256][0], tags[273], tags[279]
        together = all(a + n == b for a, n, b in zip(starts, lengths, starts[1:], strict=False))
        plain = together and tags.get(317, (1,))[0] == 1 and sum(lengths) == h * w * np.dtype(kind).itemsize
        return (starts[0], h, w, np.dtype(kind).newbyteorder(order).str) if plain else None
    except (KeyError, ValueError, struct.error):  # tags behind the head, or another format: the decoder takes the file
        return None


def row_ranges(path: str, seg_id: str, z: int, size: int, range_bytes: int) -> list[RowRange]:
    """What tasks read of one file."""
    store, place = _store(path)
    with store.open_input_file(place) as f:
        plain = _plain_rows(f.read(min(size, _HEAD)))
    if plain is None:
        return [RowRange(path, seg_id, z)]
    start, h, w, kind = plain
    row = max(1, w * np.dtype(kind).itemsize)
    step = max(1, range_bytes // row)
    return [RowRange(path, seg_id, z, start + y * row, (min(y + step, h) - y) * row, y, min(y + step, h) - y, w, kind) for y in range(0, h, step)]


def _pixels(r: RowRange) -> Iterator[pa.RecordBatch]:
    store, place = _store(r.path)
    with store.open_input_file(place) as f:
        if r.kind:
            f.seek(r.start)
            img = np.frombuffer(f.read(r.length), r.kind).reshape(r.h, r.w)
        else:
            img = raster.decode(f.read())
    for y in range(0, img.shape[0], 256):
        part = img[y : y + 256]
        part = part >> 8 if part.dtype.kind == "u" and part.dtype.itemsize == 2 else part.astype(np.uint8)
        yy, xx = np.indices(part.shape, np.int32)
        n = part.size
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.seg_id] * n, pa.string()), pa.array(np.full(n, r.z, np.int32)), pa.array((yy + np.int32(r.y + y)).ravel()), pa.array(xx.ravel()), pa.array(part.astype(np.int32).ravel())],
            names=["seg_id", "z", "y", "x", "v"],
        )


class LayerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "")
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.conditions: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of seg_id and z choose files; the others are left to Spark."""
        for f in filters:
            at = {("seg_id",): 0, ("z",): 1}.get(getattr(f, "attribute", None))
            if at is None or type(f) not in _COMPARE:
                yield f
            else:
                self.conditions.append((at, type(f), f.value))

    def partitions(self) -> list[RowRange]:
        out = []
        for path, seg_id, z, size in list_layers(self.path, self.pattern):
            if all(_COMPARE[kind]((seg_id, z)[at], value) for at, kind, value in self.conditions):
                out += row_ranges(path, seg_id, z, size, self.range_bytes)
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _pixels(partition)  # no partitions are read as one without a range


class LayerStream(DataSourceStreamReader):
    """Files are admitted by entries of a log, each written once and never changed; an offset is a number of entries."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "")
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.most = int(options.get("filesperbatch", 64))
        self.log = options["log"]

    def _entries(self, first: int = 0, last: int | None = None) -> list[list]:
        """The files of entries [first, last)."""
        store, root = _store(self.log)
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".json"))
        out = []
        for name in names[first:last]:
            with store.open_input_file(name) as f:
                out.append(json.loads(f.read()))
        return out

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        """Admits files that no entry has, one entry at a time. A file is whole when it appears, as by renaming it."""
        entries = self._entries()
        known = {f[0] for e in entries for f in e}
        new = [f for f in list_layers(self.path, self.pattern) if f[0] not in known][: self.most]
        if new:
            store, root = _store(self.log)
            store.create_dir(root, recursive=True)
            name = f"{root}/{len(entries):012d}"
            with store.open_output_stream(f"{name}.part") as f:
                f.write(json.dumps(new).encode())
            store.move(f"{name}.part", f"{name}.json")
        return {"entries": len(entries) + bool(new)}

    def partitions(self, start: dict, end: dict) -> list[RowRange]:
        return [r for e in self._entries(start["entries"], end["entries"]) for f in e for r in row_ranges(*f, self.range_bytes)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        return _pixels(partition)

    def commit(self, end: dict) -> None:
        """The log stays, since a restart may ask for the last entries again."""


class Layers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayerReader:
        return LayerReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> LayerStream:
        return LayerStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Layers)


def read_layers(spark: SparkSession, path: str, **options) -> DataFrame:
    """(seg_id, z, y, x, v) of the layers under a folder; 16-bit values are cut to 8 bits."""
    register(spark)
    return spark.read.format("layers").options(**options).load(path)


def stream_layers(spark: SparkSession, path: str, log: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("layers").options(log=log, **options).load(path)


def write_layers(vox: DataFrame, path: str) -> DataFrame:
    """Writes each layer as a NumPy array of bytes, `path`/segment/layers/number.npy, and returns (seg_id, z, path). A layer is put
    together in strips of 256 rows, so that a task holds a strip; the file is written strip by strip by one task."""
    size = vox.groupBy("seg_id").agg((F.max("y") + 1).cast("int").alias("_h"), (F.max("x") + 1).cast("int").alias("_w"))
    v = vox.select("seg_id", "z", "y", "x", F.col("v").cast("int").alias("v")).withColumn("strip", F.floor(F.col("y") / 256).cast("int"))

    def strip(key: tuple, t: pa.Table) -> pa.Table:
        seg_id, z, at, h, w = (k.as_py() for k in key)
        img = np.zeros((min(256, h - 256 * at), w), np.uint8)
        img[t["y"].to_numpy() - 256 * at, t["x"].to_numpy()] = t["v"].to_numpy()
        return pa.table({"seg_id": [seg_id], "z": pa.array([z], pa.int32()), "strip": pa.array([at], pa.int32()), "h": pa.array([h], pa.int32()), "w": pa.array([w], pa.int32()), "data": pa.array([img.tobytes()], pa.binary())})

    strips = v.join(size, "seg_id").groupBy("seg_id", "z", "strip", F.col("_h").alias("h"), F.col("_w").alias("w")).applyInArrow(strip, "seg_id string, z int, strip int, h int, w int, data binary")
    together = strips.repartition("seg_id", "z").sortWithinPartitions("seg_id", "z", "strip")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        at, out, rows = None, None, 0

        def close() -> pa.RecordBatch:
            seg_id, z, h, w = at
            out.write(bytes((h - rows) * w))  # strips without a value at the end
            out.close()
            place = f"{root}/{seg_id}/layers/{z:02d}.npy"
            store.move(f"{place}.part", place)
            return pa.RecordBatch.from_arrays([pa.array([seg_id]), pa.array([z], pa.int32()), pa.array([place])], names=["seg_id", "z", "path"])

        for batch in batches:
            for r in batch.to_pylist():
                layer = (r["seg_id"], r["z"], r["h"], r["w"])
                if layer != at:
                    if at is not None:
                        yield close()
                    at, rows = layer, 0
                    store.create_dir(f"{root}/{r['seg_id']}/layers", recursive=True)
                    out = store.open_output_stream(f"{root}/{r['seg_id']}/layers/{r['z']:02d}.npy.part")
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "|u1", "fortran_order": False, "shape": (r["h"], r["w"])})
                    out.write(head.getvalue())
                out.write(bytes((256 * r["strip"] - rows) * r["w"]))  # strips without a value before
                out.write(r["data"])
                rows = 256 * r["strip"] + len(r["data"]) // r["w"]
        if at is not None:
            yield close()

    return together.mapInArrow(write, "seg_id string, z int, path string")
