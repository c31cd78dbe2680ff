"""Layers, maps, logs and checkpoints as files.

Layers are read by Spark's binary file source and decoded in batches; the decoders here take NumPy arrays, greyscale TIFF
(plain, deflated, LZW or run lengths) and greyscale PNG, and others can be given. Pixels leave the decoder as rows; a layer is read by one task.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Layers of a labelled segment, and bytes of the smallest complete layer file.
LAYERS, LEAST_BYTES = 33, 1000


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tiff_tags(data: bytes) -> tuple[dict[int, tuple], str]:
    """Whole-number tags of a TIFF's first image, and its byte order."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise ValueError("not a baseline TIFF")
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = {1: 1, 3: 2, 4: 4}.get(kind)
        if size is None:
            continue
        where = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(order + str(count) + {1: "B", 2: "H", 4: "I"}[size], data, where)
    return tags, order


def decode_tiff(data: bytes) -> np.ndarray:
    """First image of a greyscale TIFF of 8 or 16 bits, or 32-bit floats, in strips: plain, deflated, LZW or run lengths, with
    or without differences along the rows."""
    tags, order = tiff_tags(data)
    packing, differences = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if packing not in _UNPACK or tags.get(277, (1,))[0] != 1 or differences not in (1, 2):
        raise ValueError("not a greyscale image in a known packing")
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}[tags.get(258, (1,))[0], tags.get(339, (1,))[0]]
    raw = b"".join(_UNPACK[packing](data[a : a + m]) for a, m in zip(tags[273], tags[279], strict=True))
    img = np.frombuffer(raw, np.dtype(kind).newbyteorder(order)).reshape(tags[257][0], tags[256][0])
    if differences == 2 and kind != "f4":
        img = np.cumsum(img, axis=1, dtype=np.dtype(kind))
    return img


def _run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table and 257 ends."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, width, buffer, bits, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        buffer, bits = (buffer << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = buffer >> bits
        buffer &= (1 << bits) - 1
        if code == end:
            break
        if code == clear:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


_UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _run_lengths}
_PNG = b"\x89PNG\r\n\x1a\n"


def encode_png(img: np.ndarray) -> bytes:
    """An 8-bit greyscale image."""
    h, w = img.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = img
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes())), (b"IEND", b""))
    return _PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def decode_png(data: bytes) -> np.ndarray:
    """A greyscale PNG of 8 or 16 bits that isn't interlaced."""
    at, head, packed = 8, b"", b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        head = body if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if colour != 0 or depth not in (8, 16) or interlaced:
        raise ValueError("only plain greyscale images of 8 or 16 bits are read")
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for y in range(h):
        row, way = raw[y, 1:], raw[y, 0]
        if way == 0:
            out[y] = row
        elif way == 1:
            out[y] = np.cumsum(row.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        elif way == 2:
            out[y] = row + above
        else:  # each byte depends on the one before it
            line = out[y]
            for k in range(w * step):
                left, up, corner = (int(line[k - step]) if k >= step else 0), int(above[k]), (int(above[k - step]) if k >= step else 0)
                guess = (left + up) // 2 if way == 3 else min((left, up, corner), key=lambda v, s=left + up - corner: abs(s - v))
                line[k] = (int(row[k]) + guess) & 255
        above = out[y]
    return out if step == 1 else out.view(">u2").astype(np.uint16)


def encode_tiff(img: np.ndarray) -> bytes:
    """An 8-bit greyscale image as one uncompressed strip."""
    h, w = img.shape
    raw = np.ascontiguousarray(img, np.uint8).tobytes()
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(raw))]
    entries = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags)
    return b"II" + struct.pack("<HI", 42, 8 + len(raw)) + raw + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def decode(data: bytes) -> np.ndarray:
    if data[:6] == b"\x93NUMPY":
        return decode_npy(data)
    return decode_png(data) if data[:8] == _PNG else decode_tiff(data)


def segment_of(path: Column) -> Column:
    """The folder above the file, or above the layers' own folder."""
    return F.regexp_extract(path, r"([^/]+)/(?:layers/|surface_volume/)?[^/]+$", 1)


def layer_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.[A-Za-z]+$", 1).cast("int")


def layer_files(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """seg_id, z, path, length of the layer files under a folder; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return f.select(segment_of(F.col("path")).alias("seg_id"), layer_of(F.col("path")).alias("z"), "path", "length")


def inventory(files: DataFrame) -> DataFrame:
    """Layers and size of each segment."""
    return files.groupBy("seg_id").agg(F.count("*").alias("layers"), F.sum("length").alias("bytes"))


def complete_segments(files: DataFrame, labelled: DataFrame, *, layers: int = LAYERS, least: int = LEAST_BYTES) -> DataFrame:
    """Segments with all layers, each of a sensible size, and a label."""
    ok = files.groupBy("seg_id").agg(F.count("*").alias("n"), F.min("length").alias("least")).where((F.col("n") == layers) & (F.col("least") > least))
    return ok.join(labelled.select("seg_id").distinct(), "seg_id", "left_semi").select("seg_id")


def read_volume(spark: SparkSession, root: str, pattern: str = "*.tif", *, z: tuple[int, int] | None = None, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(seg_id, z, y, x, v) of the layers under a folder; 16-bit values are cut to 8 bits. z: layers [first, last)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    f = f.select(segment_of(F.col("path")).alias("seg_id"), layer_of(F.col("path")).alias("z"), "content")
    if z is not None:
        f = f.where((F.col("z") >= z[0]) & (F.col("z") < z[1]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for seg, layer, data in zip(p["seg_id"], p["z"], p["content"], strict=True):
                img = decoder(data)
                img = img >> 8 if img.dtype == np.uint16 else img.astype(np.uint8)
                for y in range(0, img.shape[0], 256):
                    part = img[y : y + 256]
                    yy, xx = np.indices(part.shape, np.int32)
                    yield pd.DataFrame({"seg_id": seg, "z": np.int32(layer), "y": (yy + y).ravel().astype(np.int32), "x": xx.ravel().astype(np.int32), "v": part.ravel().astype(np.int32)})

    return f.mapInPandas(run, "seg_id string, z int, y int, x int, v int")


def read_map(spark: SparkSession, path: str, *, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(seg_id, y, x, v) of map files, as they are; `scaled_map` brings bytes to [0, 1]."""
    return image_pixels(spark.read.format("binaryFile").load(path).select(segment_of(F.col("path")).alias("seg_id"), "content"), "content", decoder)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The keys and values of JSON files, each one object over several lines."""
    return spark.read.option("multiLine", True).json(path)


def write_map(prob: DataFrame, path: str, version: int) -> None:
    """A map as table and as bytes (p * 255, cut), under its segment and version."""
    out = prob.select("seg_id", "y", "x", "p", (F.col("p") * 255).cast("int").alias("byte"), F.lit(version).alias("version"))
    out.write.mode("append").partitionBy("seg_id", "version").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_version(maps: DataFrame) -> DataFrame:
    """The newest version of each segment, by number."""
    return maps.groupBy("seg_id").agg(F.max("version").alias("version"))


def images(prob: DataFrame, encode: Callable[[np.ndarray], bytes] = encode_tiff, column: str = "tiff") -> DataFrame:
    """(seg_id, `column`) of maps that fit a task each, as 8-bit images; places without a row are 0."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.uint8)
        img[pdf["y"], pdf["x"]] = (pdf["p"].to_numpy() * 255).astype(np.uint8)
        return pd.DataFrame({"seg_id": [key[0]], column: [encode(img)]})

    return prob.groupBy("seg_id").applyInPandas(run, f"seg_id string, `{column}` binary")


def image_pixels(files: DataFrame, column: str, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(seg_id, y, x, v) of (seg_id, `column`) images, as they are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for seg, data in zip(p["seg_id"], p[column], strict=True):
                img = decoder(bytes(data)).astype(np.float64)
                for y in range(0, img.shape[0], 256):
                    part = img[y : y + 256]
                    yy, xx = np.indices(part.shape, np.int32)
                    yield pd.DataFrame({"seg_id": seg, "y": (yy + y).ravel().astype(np.int32), "x": xx.ravel(), "v": part.ravel()})

    return files.select("seg_id", column).mapInPandas(run, "seg_id string, y int, x int, v double")


def candidates_wide(cands: DataFrame, k: int = 5) -> DataFrame:
    """The candidates' table for CSV: letters and then confidences of the k best, padded by empty text.

    cands: id, area, y0, x0, y1, x1 and matches array<struct<letter, prob>>."""
    at = lambda i: F.get("matches", F.lit(i))
    return cands.select("id", "area", "y0", "x0", "y1", "x1", *(F.coalesce(at(i)["letter"], F.lit("")).alias(f"top{i + 1}_letter") for i in range(k)), *(F.coalesce(S.fixed(at(i)["prob"], 3), F.lit("")).alias(f"top{i + 1}_conf") for i in range(k)))


def append_log(spark: SparkSession, path: str, entries: list[dict]) -> None:
    """Adds entries to a JSON log, each with the time in UTC."""
    rows = spark.createDataFrame(entries).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows.coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a log; lines that aren't JSON are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    return rows.where("_bad is null").drop("_bad")


def layer_url(template: str, seg: Column, z: Column) -> Column:
    """Addresses of layers, the number padded to two digits."""
    return F.format_string(template, seg, F.lpad(z.cast("string"), 2, "0"))
