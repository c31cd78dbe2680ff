"""Token ids in canonical length-limited Huffman code.

One pass tokenises and counts; the code is made on the driver from the counts (as many as the vocabulary has ids), by
package-merge; a second pass writes documents in id order as independent blocks of whole documents. A block holds its
documents' ids and lengths, its bits, and a checkpoint of the bit offset every few symbols, so that a reader starts at
any of them and decodes all stretches of many blocks abreast, by one table look-up for each symbol.

A file is a folder of Parquet files with one block a row, beside a folder with the code lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._session import parts, shared_dir, work_path
from ._text import bytes_of, chunks
from ._words import WordTokenizer


@dataclass(frozen=True)
class HuffmanSettings:
    """end_id: closes each document. block: symbols at least of a block, documents being whole. step: symbols between
    checkpoints. limit: bits at most of a code; more are allowed only where the ids in use need it."""

    end_id: int = 2
    block: int = 1 << 16
    step: int = 256
    limit: int = 16


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of least total under the limit, by package-merge; 0 where the count is 0. A lone symbol has 1 bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    # for each level, how many of the cheapest items are taken decides how often a symbol is; packages are merged pairs
    levels = []
    merged = weight
    leaf = np.ones(len(weight), bool)
    levels.append(leaf)
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate([weight, pairs])
        by = np.argsort(every, kind="stable")
        merged = every[by]
        levels.append(by < len(weight))
    take = 2 * len(weight) - 2
    length = np.zeros(len(weight), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    ls = lengths[order].astype(np.int64)
    out = np.empty(len(order), np.uint32)
    for n in np.unique(ls):
        code <<= int(n) - last
        m = int((ls == n).sum())
        out[ls == n] = code + np.arange(m)
        code, last = code + m, int(n)
    codes[order] = out
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int) -> tuple[bytes, np.ndarray]:
    """(bits, checkpoints): the codes end to end, most significant bit first; bit offset of every step-th symbol."""
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    total = int(at[-1] + n[-1]) if len(ids) else 0
    words = np.zeros((total >> 5) + 2, np.uint32)
    if len(ids):
        lane = codes[ids].astype(np.uint64) << (64 - (at & 31) - n).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lane = np.bitwise_or.reduceat(lane, first)
        words[word[first]] |= (lane >> np.uint64(32)).astype(np.uint32)
        words[word[first] + 1] |= (lane & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::step].astype(np.uint32)


class Decoder:
    """Table-driven decoder: the next `bits` bits give the symbol and its length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(codes[used].astype(np.int64) << (self.bits - lengths[used].astype(np.int64)), kind="stable")]
        span = 1 << (self.bits - lengths[used].astype(np.int64))
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.length = np.ones(1 << self.bits, np.uint8)
        self.symbol[: int(span.sum())] = np.repeat(used, span)
        self.length[: int(span.sum())] = np.repeat(lengths[used], span)

    def unpack(self, data: bytes, begin: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
        """Symbols of stretches that begin at bits `begin` and have `count` symbols, step at most, end to end."""
        raw = np.frombuffer(data + bytes(8), np.uint8)
        windows = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
        out = np.zeros((len(begin), step), np.uint32)
        at = begin.astype(np.int64)
        mask, down = np.uint64((1 << self.bits) - 1), np.uint64(64 - self.bits)
        last = len(windows) - 1
        for k in range(int(count.max(initial=0))):
            look = windows[np.minimum(at >> 3, last)].astype(np.uint64)
            look = (look >> (down - (at & 7).astype(np.uint64))) & mask
            out[:, k] = self.symbol[look]
            at += self.length[look]
        return out[np.arange(step)[None, :] < count[:, None]]


def _tokenise(path: str, end_id: int):
    def run(batches):
        words = WordTokenizer.at(path)
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, off = bytes_of(batch["text"])
            ids = batch["doc_id"]
            for i, j in chunks(off, 2 << 20):
                got, n = words.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                c = np.bincount(got)
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
                small = got.astype("<u2") if not len(got) or got.max() < 1 << 16 else got.astype("<u4")
                raw, cut = small.tobytes(), np.append(0, np.cumsum(n * small.itemsize))
                m = j - i
                yield pa.RecordBatch.from_arrays([ids.slice(i, m), pa.array(n, pa.int64()), pa.array(np.full(m, small.itemsize, np.int32)), pa.array([raw[cut[k] : cut[k + 1]] for k in range(m)], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=_TOKENS)
        some = np.flatnonzero(total)
        m = len(some)
        if m:
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=_TOKENS)

    return run


_TOKENS = ["doc_id", "n_tokens", "width", "ids", "token", "times"]


def _blocks(lengths: np.ndarray, s: HuffmanSettings):
    codes = canonical(lengths)

    def block(have: list, number: int, part: int) -> list:
        ids = np.concatenate([np.frombuffer(x, f"<u{w}") for _, _, w, x in have])
        data, marks = pack(ids, codes, lengths, s.step)
        return [part, number, len(ids), [x[0] for x in have], [x[1] for x in have], data, marks.astype("<u4").tobytes()]

    def batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["part", "number", "n_symbols", "doc_ids", "doc_lengths", "bits", "checkpoints"])

    def run(batches):
        from pyspark import TaskContext

        part, number, have, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for x in zip(b["doc_id"].to_pylist(), b["n_tokens"].to_pylist(), b["width"].to_pylist(), b["ids"].to_pylist(), strict=True):
                have.append(x)
                size += x[1]
                if size >= s.block:
                    yield batch([block(have, number, part)])
                    number, have, size = number + 1, [], 0
        if have:
            yield batch([block(have, number, part)])

    return run


def _decode(lengths: np.ndarray, step: int):
    def run(batches):
        decoder = Decoder(lengths)
        for b in batches:
            for i in range(0, b.num_rows, 16):
                part = b.slice(i, 16)
                data, at, begin, count = [], 0, [], []
                for bits, marks, n in zip(part["bits"].to_pylist(), part["checkpoints"].to_pylist(), part["n_symbols"].to_pylist(), strict=True):
                    marks = np.frombuffer(marks, "<u4").astype(np.int64) + 8 * at
                    begin.append(marks)
                    c = np.full(len(marks), step, np.int64)
                    if len(c):
                        c[-1] = n - step * (len(c) - 1)
                    count.append(c)
                    data.append(bits)
                    at += len(bits)
                ids = decoder.unpack(b"".join(data), np.concatenate(begin), np.concatenate(count), step).astype("<u4")
                docs = [d for x in part["doc_ids"].to_pylist() for d in x]
                lens = [n for x in part["doc_lengths"].to_pylist() for n in x]
                first = np.repeat(np.array(part["first"].to_pylist(), np.int64), [len(x) for x in part["doc_ids"].to_pylist()])
                blocks = np.repeat(np.cumsum(part["n_symbols"].to_numpy()) - part["n_symbols"].to_numpy(), [len(x) for x in part["doc_ids"].to_pylist()])
                cut = np.append(0, np.cumsum(lens))
                raw = [ids[cut[k] : cut[k + 1]].tobytes() for k in range(len(docs))]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + cut[:-1] - blocks, pa.int64()), pa.array(lens, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of all texts, each closed by the end id, written to the shared folder: doc_id, n_tokens, width and ids
    (little-endian unsigned numbers of `width` bytes); and rows without ids, but with token and times, whose sums are the
    counts of all tokens. A null text is empty."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw = work_path(spark, "ids")
    schema = "doc_id long, n_tokens long, width int, ids binary, token int, times long"
    d.mapInArrow(_tokenise(tokenizer_path, end_id), schema).write.option("compression", "zstd").parquet(raw)
    return spark.read.schema(schema).parquet(raw)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, settings: HuffmanSettings | None = None) -> None:
    """Writes the ids of all texts of `docs`, each closed by the end id, in ascending order of the document ids.

    A null text is empty: its end id only. Rows without an id come last; rows that repeat an id are all written. An
    empty table gives a file without blocks.
    """
    s = settings or HuffmanSettings()
    spark = docs.sparkSession
    got = tokenised(docs, tokenizer_path, s.end_id, id_col, text_col)
    counted = got.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max((r[0] for r in counted), default=s.end_id) + 1, np.int64)
    for token, times in counted:
        counts[token] = times
    lengths = code_lengths(counts, s.limit)
    spark.createDataFrame([(lengths.tobytes(), s.step)], "lengths binary, step int").coalesce(1).write.parquet(f"{path}/code")
    ordered = got.where("token is null").select("doc_id", "n_tokens", "width", "ids")
    ordered = ordered.repartitionByRange(parts(docs), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "ids")
    schema = "part int, number long, n_symbols long, doc_ids array<long>, doc_lengths array<long>, bits binary, checkpoints binary"
    ordered.mapInArrow(_blocks(lengths, s), schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of a file."""
    code = spark.read.parquet(f"{path}/code").first()
    lengths = np.frombuffer(bytes(code["lengths"]), np.uint8)
    blocks = spark.read.schema("part int, number long, n_symbols long, doc_ids array<long>, doc_lengths array<long>, bits binary, checkpoints binary").parquet(f"{path}/blocks")
    # one row for each part of the file, then one for each of its blocks
    base = blocks.groupBy("part").agg(F.sum("n_symbols").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    within = blocks.select("part", "number", F.sum("n_symbols").over(W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)).alias("within"))
    first = F.coalesce("base", F.lit(0)) + F.coalesce("within", F.lit(0))
    placed = blocks.join(within.join(base, "part").select("part", "number", first.alias("first")), ["part", "number"])
    return placed.select("first", "n_symbols", "doc_ids", "doc_lengths", "bits", "checkpoints").mapInArrow(_decode(lengths, code["step"]), "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, tokenizer_path: str, path: str | None = None, **given) -> DataFrame:
    """Writes `docs` as tokens and reads them back: doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers). See `write_tokens` for nulls, repeated rows and empty tables."""
    spark = docs.sparkSession
    shared_dir(spark)
    path = path or work_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, **given)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
