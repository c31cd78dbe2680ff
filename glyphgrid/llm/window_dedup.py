"""Removal of word windows that stand earlier in the corpus, behind a count-min prefilter.

First pass: each block of texts sketches its windows: counters that saturate at two, in rows of cells that different bits of
a window's hash choose. Sketches are sparse, so that a block sends only the cells it touches, to the shard that the hash
names. Shards merge the sketches by adding the counters, folded to a width that fits what arrived, and answer for each
cell sent whether the sum is two or more. A window all of whose cells say so is estimated repeated; sums never fall short
of true counts, so no repeated window is missed. Second pass: only windows estimated repeated are sent, by 128 bits of
hash, and grouped exactly, to find which occurrence is first.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import block_of, by_key, by_key2, parts
from ._text import U64, bytes_of, chunks, column, span_hashes, window_hashes, word_spans


@dataclass(frozen=True)
class WindowSettings:
    """window: words of a window. depth: rows of the sketch, 3 at most. width_bits: binary logarithm of the cells of a row in a
    shard, 32 at most; shards fold rows to eight to sixteen cells for each one sent, where that is less."""

    window: int = 20
    depth: int = 2
    width_bits: int = 26


class _Block:
    """The texts of one block in order, with their words and windows."""

    def __init__(self, table: pa.Table, s: WindowSettings):
        ids = column(table["place"]).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        if len(ids) and (np.diff(ids[order]) == 0).any():
            texts = column(table["text"]).to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")), np.int64)
        self.table, self.ids, self.s = table.take(pa.array(order)), ids[order], s
        self.data, self.off = bytes_of(self.table["text"])

    def words(self):
        """Per chunk: first byte, words' starts and ends, and first word of each row."""
        for i, j in chunks(self.off):
            lo, hi = self.off[i], self.off[j]
            local = self.off[i : j + 1] - lo
            a, z = word_spans(self.data[lo:hi], local)
            yield i, j, lo, a, z, np.searchsorted(a, local)

    def windows(self) -> None:
        """Two hashes of each window, in order; and the number of words and of windows of each row."""
        n = self.s.window
        hashes: tuple[list[np.ndarray], ...] = ([], [])
        self.n_words = np.zeros(len(self.ids), np.int64)
        for i, j, lo, a, z, first in self.words():
            self.n_words[i:j] = np.diff(first)
            if len(a) < n:
                continue
            inside = np.repeat(first[1:], np.diff(first)) >= np.arange(len(a)) + n
            for seed, out in enumerate(hashes):
                h = window_hashes(span_hashes(self.data[lo : self.off[j]], a, z, seed), n)
                out.append(h[inside[: len(h)]])
        self.hashes = [np.concatenate(x) if x else np.zeros(0, U64) for x in hashes]
        self.n_windows = np.maximum(self.n_words - n + 1, 0)

    def cells(self, row: int, shards: int) -> np.ndarray:
        """Shard and cell of each window in a row of the sketch, as one number."""
        h, g = self.hashes
        bits = (h, g, g >> U64(32))[row] & U64(0xFFFFFFFF)
        return (((h >> U64(32)) * U64(shards) >> U64(32)) << U64(32)) | (bits >> U64(32 - self.s.width_bits))

    def distinct(self, shards: int) -> tuple[np.ndarray, ...]:
        """Distinct windows, by both hashes, in shards' order: place of the first occurrence, shard bounds; and each window's number."""
        h, g = self.hashes
        by = np.argsort(h, kind="stable")
        v, w = h[by], g[by]
        if ((v[1:] == v[:-1]) & (w[1:] != w[:-1])).any():
            by = np.lexsort((g, h))
            v, w = h[by], g[by]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))) if len(v) else np.zeros(0, np.int64)
        of = np.empty(len(v), np.int32)
        of[by] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(v))))
        # hashes are sorted, so that the shards, which are their ranges, are too
        bounds = np.searchsorted((v[first] >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1, dtype=U64))
        return by[first], bounds, of


def _gaps(cells: np.ndarray) -> bytes:
    """Ascending numbers as differences, each in as many bytes of seven bits as it needs."""
    d = np.diff(cells, prepend=U64(0)).astype(U64)
    size = 1 + sum((d >= U64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        live = size > k
        if not live.any():
            break
        out[at[live] + k] = ((d[live] >> U64(7 * k)) & U64(127)).astype(np.uint8) | ((size[live] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    head = np.flatnonzero(np.append(True, raw[:-1] < 128))
    place = np.arange(len(raw)) - np.repeat(head, np.diff(np.append(head, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), head))


def _sketch(key: tuple, table: pa.Table, *, s: WindowSettings, shards: int) -> pa.Table:
    """The block's sketch: of each row and shard the cells touched, and a bit for those whose counter is two."""
    b = _Block(table, s)
    b.windows()
    shard, row, data, twice = [], [], [], []
    for r in range(s.depth):
        c = np.sort(b.cells(r, shards))
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        more, c = np.diff(np.append(head, len(c))) > 1, c[head]
        cut = np.searchsorted(c >> U64(32), np.arange(shards + 1, dtype=U64))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[k], cut[k + 1])
            shard.append(k), row.append(r), data.append(_gaps(c[part] & U64(0xFFFFFFFF))), twice.append(np.packbits(more[part]).tobytes())
    n = len(shard)
    return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array([key[0].as_py()] * n, pa.int32()), "row": pa.array(row, pa.int32()), "data": pa.array(data, pa.binary()), "twice": pa.array(twice, pa.binary())})


def _merge(key: tuple, table: pa.Table, *, s: WindowSettings) -> pa.Table:
    """Adds up the blocks' sketches of a shard; answers each with a bit for every cell whose sum is two or more."""
    rows, out = table["row"].to_numpy(), [b""] * len(table)
    for r in range(s.depth):
        own = np.flatnonzero(rows == r).tolist()
        cells = [_from_gaps(table["data"][k].as_py()) for k in own]
        fold = max(0, s.width_bits - (8 * max(1, sum(map(len, cells)))).bit_length())
        count = np.zeros(1 << (s.width_bits - fold), np.uint8)
        for k, c in zip(own, cells, strict=True):  # a block's cells differ, but may fold into one
            c >>= fold
            more = np.unpackbits(np.frombuffer(table["twice"][k].as_py(), np.uint8))[: len(c)]
            if fold:
                count[c[1:][c[1:] == c[:-1]]] = 2
            count[c] = np.minimum(count[c] + 1 + more, 2)
        for k, c in zip(own, cells, strict=True):
            out[k] = np.packbits(count[c] >= 2).tobytes()
    return pa.table({"block": table["block"], "shard": table["shard"], "row": table["row"], "data": pa.array(out, pa.binary())})


def _repeated(b: _Block, answers: pa.Table, shards: int) -> np.ndarray:
    """Whether each window is estimated repeated: all its cells are at two."""
    out = np.ones(len(b.hashes[0]), bool)
    shard, row = answers["shard"].to_numpy(), answers["row"].to_numpy()
    for r in range(b.s.depth):
        c = b.cells(r, shards)
        by = np.argsort(c)
        c = c[by]
        head = np.append(True, c[1:] != c[:-1]) if len(c) else np.zeros(0, bool)
        cut = np.searchsorted(c[head] >> U64(32), np.arange(shards + 1, dtype=U64))
        mark = np.zeros(int(head.sum()), bool)
        for k in np.flatnonzero(row == r).tolist():
            x, y = int(cut[shard[k]]), int(cut[shard[k] + 1])
            mark[x:y] = np.unpackbits(np.frombuffer(answers["data"][k].as_py(), np.uint8))[: y - x]
        out[by] &= mark[np.cumsum(head) - 1]
    return out


_EXACT = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8")])


def _exact(key: tuple, docs: pa.Table, answers: pa.Table, *, s: WindowSettings, shards: int) -> pa.Table:
    """For each window estimated repeated: its two hashes and the block's first document with it. A mark keeps the order."""
    b = _Block(docs, s)
    b.windows()
    place, bounds, _ = b.distinct(shards)
    mark = _repeated(b, answers, shards)[place]
    row = np.repeat(np.arange(len(b.ids)), b.n_windows)
    every = np.empty(int(mark.sum()), _EXACT)
    every["h"], every["g"], every["doc"] = b.hashes[0][place[mark]], b.hashes[1][place[mark]], b.ids[row[place[mark]]]
    at = np.append(0, np.cumsum(mark))[bounds]
    some = np.flatnonzero(np.diff(at))
    return pa.table({"shard": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), key[0].as_py(), np.int32)), "bits": pa.array([np.packbits(mark[bounds[k] : bounds[k + 1]]).tobytes() for k in some], pa.binary()), "data": pa.array([every[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())})


def _first(key: tuple, table: pa.Table) -> pa.Table:
    """Groups the shard's windows exactly; answers each block which of them a smaller document of another block holds."""
    sent = [np.frombuffer(x, _EXACT) for x in table["data"].to_pylist()]
    every = np.concatenate(sent)
    out = np.zeros(len(every), bool)
    if len(every):
        order = np.lexsort((every["doc"], every["g"], every["h"]))
        x = every[order]
        first = np.flatnonzero(np.append(True, (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])))
        size = np.diff(np.append(first, len(x)))
        out[order] = x["doc"] > np.repeat(x["doc"][first], size)
    data, at = [], 0
    for x in sent:
        data.append(np.packbits(out[at : at + len(x)]).tobytes())
        at += len(x)
    return pa.table({"block": table["block"], "shard": table["shard"], "bits": table["bits"], "data": pa.array(data, pa.binary())})


def _cut(key: tuple, docs: pa.Table, answers: pa.Table, *, s: WindowSettings, shards: int) -> pa.Table:
    b = _Block(docs, s)
    b.windows()
    place, bounds, of = b.distinct(shards)
    elsewhere = np.zeros(int(bounds[-1]), bool)
    for k, bits, data in zip(answers["shard"].to_pylist(), answers["bits"].to_pylist(), answers["data"].to_pylist(), strict=True):
        n = int(bounds[k + 1] - bounds[k])
        mark = np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
        part = np.zeros(n, bool)
        part[mark] = np.unpackbits(np.frombuffer(data, np.uint8))[: int(mark.sum())]
        elsewhere[bounds[k] : bounds[k + 1]] = part
    gone = elsewhere[of]
    if len(gone):
        gone |= place[of] != np.arange(len(of))
    # words covered by removed windows
    row = np.repeat(np.arange(len(b.ids)), b.n_windows)
    first_word = np.cumsum(b.n_words) - b.n_words
    first_window = np.cumsum(b.n_windows) - b.n_windows
    start = first_word[row] + np.arange(len(row)) - first_window[row]
    edge = np.zeros(int(b.n_words.sum()) + 1, np.int64)
    edge[start[gone]] += 1
    np.subtract.at(edge, start[gone] + s.window, 1)
    covered = np.cumsum(edge[:-1]) > 0
    digest, removed, at = [], [], 0
    for i, j, lo, a, z, first in b.words():
        raw = b.data[lo : b.off[j]].tobytes()
        a, z = a.tolist(), z.tolist()
        for k in range(j - i):
            n = int(first[k + 1] - first[k])
            out = covered[at : at + n]
            if n and not out.any():
                kept = raw[a[first[k]] : z[first[k + 1] - 1]].split()
                if len(kept) != n:  # split() knows more kinds of white space than the words do
                    kept = [raw[x:y] for x, y in zip(a[first[k] : first[k + 1]], z[first[k] : first[k + 1]], strict=True)]
            else:
                kept = [raw[a[w]:z[w]] for w in (first[k] + np.flatnonzero(~out)).tolist()]
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            removed.append(int(out.sum()))
            at += n
    return pa.table({"doc_id": b.table["doc_id"], "n_words": pa.array(b.n_words), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, settings: WindowSettings | None = None) -> DataFrame:
    """Removes each word covered by a window of words that also starts earlier: in a document of a smaller id, or earlier in the same.

    Returns per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank). Words are runs of
    bytes other than blank, tab, line and page ends, unchanged. Windows are judged on the input.

    A null text has no words. Texts of fewer words than a window lose none. Rows with one id count as one document
    in the order of their texts. Rows without an id come after all others, ordered by a hash of their texts (from 2 ** 62
    on among the ids), so that rows of equal texts are one document. An empty table gives none.
    """
    s = settings or WindowSettings()
    n = parts(docs)
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    place = F.coalesce(doc_id, F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62))
    d = docs.select(doc_id.alias("doc_id"), text.alias("text"), place.alias("place"), block_of(place, n).alias("block"))
    sketch = d.groupBy("block").applyInArrow(by_key(_sketch, s=s, shards=n), "shard int, block int, row int, data binary, twice binary")
    repeated = sketch.groupBy("shard").applyInArrow(by_key(_merge, s=s), "block int, shard int, row int, data binary")
    exact = d.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(by_key2(_exact, s=s, shards=n), "shard int, block int, bits binary, data binary")
    answers = exact.groupBy("shard").applyInArrow(by_key(_first), "block int, shard int, bits binary, data binary")
    return d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(by_key2(_cut, s=s, shards=n), "doc_id long, n_words long, n_removed long, kept_sha256 string")
