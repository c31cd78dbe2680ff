"""Packing of token sequences into bins of several permitted lengths, by variable-capacity best fit.

Sequences are dealt into shards by the hash of their id; each shard packs its own, longest first. A sequence goes into
the open bin that it fills best; if none has room, the bin size of least cost is opened: the cost of a size is its
length times the share of it that is expected to stay empty, given how much of the shard is still to come, plus a
fixed cost of a bin. In the end each bin is cut down to the smallest permitted length that holds its contents.
Sequences longer than the largest size are first cut into full pieces and a rest.

`best_fit_pack` works on lengths alone; `pack_tokens` takes the token ids along and returns the filled bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._counts import word_count
from ._session import by_key, parts


@dataclass(frozen=True)
class PackingSettings:
    """sizes: permitted lengths. bin_cost: fixed cost of a bin, in tokens."""

    sizes: tuple[int, ...] = (512, 1024, 2048, 4096)
    bin_cost: int = 16


def cheapest_size(length: int, ahead: list[int], upto: list[int], s: PackingSettings) -> int:
    """The permitted size of least cost for a token of a new bin that starts with a sequence of `length`.

    ahead: the lengths still to come, ascending; upto: running totals, of these at least. What a size has left beyond the sequence is
    filled by later ones no longer than the room: at best wholly, if they are enough, else as far as they go.
    """
    best, cost = 0, float("inf")
    for size in sorted(s.sizes):
        if size < length:
            continue
        room = size - length
        k = bisect_left(ahead, room + 1)
        fill = min(room, upto[k])
        if k and fill == room and ahead[0] > 1:  # whole sequences leave half the shortest over, on average
            fill = max(0, room - ahead[0] // 2)
        final = min(x for x in s.sizes if x >= length + fill)  # a bin is cut down in the end
        now = (final + s.bin_cost) / (length + fill) if length + fill else float(final)
        if now < cost:
            best, cost = size, now
    return best


def pack_lengths(lengths: np.ndarray, s: PackingSettings) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each sequence, none longer than the largest size, and the final size of each bin. Empty
    sequences take no room: they go to the first bin."""
    order = np.argsort(-lengths, kind="stable").tolist()
    ahead = sorted(int(x) for x in lengths if x > 0)
    total = np.append(0, np.cumsum(ahead)).tolist()
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    size_of: list[int] = []
    room: list[tuple[int, int]] = []  # (tokens left, bin), ascending
    for k in order:
        n = int(lengths[k])
        if n == 0:
            if not used:
                used.append(0), size_of.append(min(s.sizes))
                insort(room, (min(s.sizes), 0))
            continue
        ahead.pop()  # the longest: this one
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(used), cheapest_size(n, ahead, total, s)
            used.append(0), size_of.append(left)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    return bins, offsets, [min(x for x in s.sizes if x >= u) for u in used]


def _pieces(ids: list, n: np.ndarray, more: list | None, s: PackingSettings) -> tuple[list[int], list[int], list[int], list[int]]:
    """Row, number, start and length of each piece; rows in the order of their ids, lengths and what else they have."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], n[i], more[i] if more else None))
    most = max(s.sizes)
    row, piece, start, length = [], [], [], []
    for i in order:
        m, k = int(n[i]), 0
        while k == 0 or m > 0:
            row.append(i), piece.append(k), start.append(k * most), length.append(min(m, most))
            m, k = m - most, k + 1
    return row, piece, start, length


def _fill_shard(key: tuple, table: pa.Table, *, s: PackingSettings) -> pa.Table:
    """The shard's bins: of each the pieces in it, in their order there, and their tokens."""
    docs, raw, width = table["doc_id"].to_pylist(), table["ids"].to_pylist(), table["width"].to_pylist()
    row, piece, start, length = _pieces(docs, table["n_tokens"].to_numpy(), raw, s)
    bins, offsets, sizes = pack_lengths(np.array(length, np.int64), s)
    out: list[list[int]] = [[] for _ in sizes]
    for k in np.lexsort((np.array(length), offsets, bins)).tolist():
        out[bins[k]].append(k)
    tokens = [b"".join(np.frombuffer(raw[row[k]], f"<u{width[row[k]]}", length[k], start[k] * width[row[k]]).astype("<u4").tobytes() for k in have) for have in out]
    lists = lambda of, kind: pa.array([[of[k] for k in have] for have in out], pa.list_(kind))
    return pa.table({
        "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "bin": pa.array(range(len(out)), pa.int64()), "bin_size": pa.array(sizes, pa.int64()),
        "doc_ids": lists([docs[i] for i in row], pa.int64()), "pieces": lists(piece, pa.int32()), "starts": lists(start, pa.int64()), "lengths": lists(length, pa.int64()), "offsets": lists(offsets.tolist(), pa.int64()), "ids": pa.array(tokens, pa.binary()),
    })


def pack_tokens(tokens: DataFrame, *, settings: PackingSettings | None = None, shards: int | None = None) -> DataFrame:
    """Filled bins from (doc_id, n_tokens, width, ids), ids being little-endian unsigned numbers of `width` bytes: shard, bin
    (within the shard), bin_size, the lists doc_ids, pieces, starts, lengths and offsets of the pieces in it, and ids
    (little-endian unsigned 32-bit).

    A row without tokens is an empty piece of the shard's first bin. Rows that repeat an id are packed each; rows without
    an id are dealt by their place in the table, so write it first where that could change. An empty table gives none.
    """
    s = settings or PackingSettings()
    n = shards or parts(tokens)
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "n_tokens"))
    d = tokens.select("doc_id", "n_tokens", "width", "ids", F.pmod(key, F.lit(n)).cast("int").alias("shard"))
    schema = "shard int, bin long, bin_size long, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<long>, offsets array<long>, ids binary"
    return d.groupBy("shard").applyInArrow(by_key(_fill_shard, s=s), schema)


def places(bins: DataFrame) -> DataFrame:
    """Where each piece stands, and the checksum of its tokens as they are in its bin: doc_id, piece, piece_start, n_tokens,
    shard, bin, bin_offset, bin_size, ids_crc32."""
    each = F.explode(F.arrays_zip("doc_ids", "pieces", "starts", "lengths", "offsets")).alias("x")
    own = F.substring("ids", (4 * F.col("x.offsets") + 1).cast("int"), (4 * F.col("x.lengths")).cast("int"))
    return bins.select("shard", "bin", "bin_size", "ids", each).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.pieces").alias("piece"), F.col("x.starts").alias("piece_start"), F.col("x.lengths").alias("n_tokens"), "shard", "bin", F.col("x.offsets").alias("bin_offset"), "bin_size", F.crc32(own).alias("ids_crc32"))


def _pack_shard(key: tuple, table: pa.Table, *, s: PackingSettings) -> pa.Table:
    shard = key[0].as_py()
    ids = table["doc_id"].to_pylist()
    row, piece, start, length = _pieces(ids, table["n_tokens"].to_numpy(), None, s)
    bins, offsets, sizes = pack_lengths(np.array(length, np.int64), s)
    b = bins.tolist()
    return pa.table({
        "doc_id": pa.array([ids[i] for i in row], pa.int64()), "piece": pa.array(piece, pa.int32()), "piece_start": pa.array(start, pa.int64()), "n_tokens": pa.array(length, pa.int64()),
        "shard": pa.array([shard] * len(row), pa.int32()), "bin": pa.array(b, pa.int64()), "bin_offset": pa.array(offsets), "bin_size": pa.array([sizes[x] for x in b], pa.int64()),
    })


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_tokens: Column | None = None, settings: PackingSettings | None = None, shards: int | None = None) -> DataFrame:
    """Assigns each piece of each sequence to a bin: doc_id, piece, piece_start, n_tokens, shard, bin (within the shard),
    bin_offset, bin_size.

    n_tokens: length of a sequence; the number of words of the text if not given. A null text or length is 0; a
    sequence of no tokens is one empty piece of the shard's first bin. Rows that repeat an id are packed each; rows
    without an id too. Lengths must not be negative; such count as 0. An empty table gives none.
    """
    s = settings or PackingSettings()
    n = shards or parts(docs)
    count = F.greatest(F.coalesce(n_tokens if n_tokens is not None else word_count(F.col(text_col)), F.lit(0)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), count.alias("n_tokens"))
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "n_tokens"))
    d = d.withColumn("shard", F.pmod(key, F.lit(n)).cast("int"))
    schema = "doc_id long, piece int, piece_start long, n_tokens long, shard int, bin long, bin_offset long, bin_size long"
    return d.groupBy("shard").applyInArrow(by_key(_pack_shard, s=s), schema)
