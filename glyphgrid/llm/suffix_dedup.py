"""Removal of passages that an earlier document already holds, by suffix arrays.

Texts are dealt into blocks by the hash of their id. A passage of `width` bytes is routed by its *anchor*, the
least hash among its byte grams: equal passages have equal anchors, wherever they stand. Blocks send the hashes of
their anchors to shards, which answer which of them another document shares and by which holder's neighbourhood
they are to be routed. Only stretches under shared anchors travel on; each shard sorts all suffixes of its
stretches by induced sorting, computes the permuted common prefixes, and reads off, for every `width` bytes, the
least document that holds them. Anchors only choose what meets where; the suffix arrays decide.

Hot passages: a block passes on one copy of each distinct stretch, and where many stretches meet under one key it
first runs the same suffix sorting over its own, so that only what is new in the block travels on.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sais import SEPARATOR, repeated_first
from ._session import block_of, by_key, by_key2, parts
from ._text import _CODES, U64, bytes_of, chunks, column, mix, rolling, sliding_min

_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SuffixSettings:
    """width: bytes of the shortest match. gram: bytes of an anchor gram. route: bytes of a holder's neighbourhood
    under one routing key. hot: stretches of one key in one block from which the block sorts its own first.
    blocks: blocks of texts for each shuffle partition. chunk: bytes of text in one suffix array, unless one key alone has
    more."""

    width: int = 50
    gram: int = 24
    route: int = 512
    blocks: int = 2
    hot: int = 12
    chunk: int = 1 << 20


class _Block:
    """The texts of one block in id order, rows without an id last, and their anchors."""

    def __init__(self, table: pa.Table, s: SuffixSettings):
        ids = column(table["doc_id"])
        key = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(key, kind="stable")
        if len(key) and (np.diff(key[order]) == 0).any():  # repeated ids: any fixed order will do
            texts = column(table["text"]).to_pylist()
            order = np.array(sorted(range(len(key)), key=lambda i: (key[i], texts[i] or "")), np.int64)
        self.table, self.ids = table.take(pa.array(order)), key[order]
        self.data, self.off = bytes_of(self.table["text"])
        self.s = s

    def anchors(self) -> None:
        """Runs of windows with one anchor: value, row and first window; end is behind the last window."""
        s, values, rows, starts = self.s, [], [], []
        for i, j in chunks(self.off):
            lo, hi = self.off[i], self.off[j]
            least = sliding_min(rolling(_CODES[0][self.data[lo:hi]], s.gram), s.width - s.gram + 1)
            if not len(least):
                continue
            begin = self.off[i:j] - lo
            count = np.maximum(self.off[i + 1 : j + 1] - self.off[i:j] - s.width + 1, 0)
            edge = np.zeros(len(least) + 1, np.int32)
            np.add.at(edge, np.minimum(begin, len(least))[count > 0], 1)
            np.add.at(edge, np.minimum(begin + count, len(least))[count > 0], -1)
            valid = np.cumsum(edge[:-1]) > 0
            head = np.ones(len(least), bool)
            head[1:] = least[1:] != least[:-1]
            head[begin[(count > 0)]] = True
            at = np.flatnonzero(head & valid)
            values.append(least[at])
            rows.append(i + np.searchsorted(begin, at, "right") - 1)
            starts.append(at + lo)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.value, self.row, self.start = cat(values, U64), cat(rows, np.int64), cat(starts, np.int64)
        if len(self.row):  # several empty rows can share an offset: the last one has the text
            self.row = np.searchsorted(self.off, self.start, "right") - 1
        self.end = np.minimum(np.append(self.start[1:], _LAST), self.off[self.row + 1] - s.width + 1) if len(self.row) else self.start

    def shared_out(self, shards: int) -> tuple[np.ndarray, ...]:
        """Distinct anchors in the order in which they are sent: run of first holder, whether rows of several ids hold it, shard, print; and each run's place in that order."""
        order = np.argsort(self.value, kind="stable")
        v = self.value[order]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(v)) - 1
        several = self.ids[self.row[order[first]]] != self.ids[self.row[order[last]]]
        h = mix(v[first])
        shard, prints = ((h & U64(0xFFFFFFFF)) % U64(shards)).astype(np.int64), (h >> U64(32)).astype(np.uint32)
        sent = np.lexsort((prints, shard))
        place = np.empty(len(first), np.int64)
        place[sent] = np.arange(len(first))
        of_run = np.empty(len(v), np.int64)
        of_run[order] = place[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))]
        return order[first][sent], several[sent], shard[sent], prints[sent], of_run


_SENT = np.dtype([("print", "<u4"), ("doc", "<u4"), ("at", "<u2")])


def _send(key: tuple, table: pa.Table, *, s: SuffixSettings, shards: int) -> pa.Table:
    b = _Block(table, s)
    b.anchors()
    run, several, shard, prints, _ = b.shared_out(shards)
    out = np.empty(len(run), _SENT)
    out["print"] = prints
    row = b.row[run]
    out["doc"] = mix(b.ids[row].astype(U64)) >> U64(32)
    out["at"] = ((b.start[run] - b.off[row]) // s.route & 0x7FFF) | (several.astype(np.int64) << 15)
    cut = np.searchsorted(shard, np.arange(shards + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.table({"shard": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), key[0].as_py(), np.int32)), "data": pa.array([out[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())})


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each block's anchors in this shard: a bit for those that are shared, then their routing keys."""
    sent = [np.frombuffer(x, _SENT) for x in column(table["data"]).to_pylist()]
    every = np.concatenate(sent)
    order = np.argsort(every["print"], kind="stable")
    p = every["print"][order]
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    size = np.diff(np.append(first, len(p)))
    route = (every["doc"].astype(U64) << U64(15)) | (every["at"] & 0x7FFF).astype(U64)
    several = (np.maximum.reduceat(every["at"][order] >> 15, first) > 0) | (size > 1)
    least = np.minimum.reduceat(route[order], first)
    mark, keys = np.empty(len(p), bool), np.empty(len(p), U64)
    mark[order], keys[order] = np.repeat(several, size), np.repeat(least, size)
    out, at = [], 0
    for x in sent:
        m = mark[at : at + len(x)]
        out.append(np.packbits(m).tobytes() + keys[at : at + len(x)][m].tobytes())
        at += len(x)
    return pa.table({"block": table["block"], "shard": table["shard"], "data": pa.array(out, pa.binary())})


def _first_holders(texts: list[bytes], owner: list[int], s: SuffixSettings):
    """Yields, for each text, the spans [a, b) of its bytes whose `width` bytes a smaller owner holds too, and the
    spans of windows that none does."""
    if not texts:
        return
    lengths = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    raw = np.frombuffer(b"".join(x + bytes([SEPARATOR]) for x in texts), np.uint8)
    own = np.array(owner, np.int64)
    held = repeated_first(raw, ends, own, s.width) < np.repeat(own, lengths + 1)
    flips = np.flatnonzero(np.diff(np.concatenate([[0], held.view(np.int8), [0]])))
    a, b = flips[::2], flips[1::2]
    begin = ends - lengths
    which = np.searchsorted(begin, a, "right") - 1
    cut = np.searchsorted(which, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        x, y = a[cut[k] : cut[k + 1]] - begin[k], b[cut[k] : cut[k + 1]] - begin[k]
        last = lengths[k] - s.width + 1
        free = np.column_stack([np.append(0, y), np.append(x, last)])
        yield list(zip((x).tolist(), (y + s.width - 1).tolist(), strict=True)), free[free[:, 1] > free[:, 0]].tolist()


_STRETCH = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i8"), ("len", "<i4")])


def _stretches(key: tuple, docs: pa.Table, answers: pa.Table, *, s: SuffixSettings, shards: int) -> pa.Table:
    """Stretches of text under shared anchors, to their shards; what the block itself can decide is marked covered."""
    block = key[0].as_py()
    b = _Block(docs, s)
    b.anchors()
    run, _, shard, _, of_run = b.shared_out(shards)
    cut = np.searchsorted(shard, np.arange(shards + 1))
    keys = np.zeros(len(run), U64)
    for k, data in zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True):
        n = int(cut[k + 1] - cut[k])
        mark = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8))[:n].astype(bool)
        keys[cut[k] : cut[k + 1]][mark] = np.frombuffer(data, U64, -1, (n + 7) // 8) + U64(1)
    of = keys[of_run]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (b.row[1:] != b.row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(of)) - 1
    keep = of[head] > 0 if len(head) else np.zeros(0, bool)
    head, tail = head[keep], tail[keep]
    raw = memoryview(b.data)
    covered: list[tuple[int, int, int]] = []
    by_key: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
    seen: dict[tuple[int, bytes], int] = {}
    ids = b.ids
    for k, row, x, y in zip(of[head].tolist(), b.row[head].tolist(), b.start[head].tolist(), (b.end[tail] + s.width - 1).tolist(), strict=True):
        text = bytes(raw[x:y])
        if ids[seen.setdefault((k, text), row)] < ids[row]:
            covered.append((row, x - int(b.off[row]), y - int(b.off[row])))
        else:
            by_key[k].append((row, x - int(b.off[row]), text))
    out: dict[int, list[tuple[int, int, int, bytes]]] = defaultdict(list)
    hot: list[tuple[int, int, int, bytes]] = []
    for k, have in by_key.items():
        if len(have) >= s.hot:
            hot += [(k, *x) for x in have]
        else:
            out[k % shards] += [(k, *x) for x in have]
    for part in _by_size(hot, s.chunk):
        for (k, row, x, text), (held, free) in zip(part, _first_holders([p[3] for p in part], [int(ids[p[1]]) for p in part], s), strict=True):
            covered += [(row, x + a, x + z) for a, z in held]
            out[k % shards] += [(k, row, x + a, text[a : z + s.width - 1]) for a, z in free]
    rows = {"shard": [], "block": [], "what": [], "text": []}
    if covered:
        rows["shard"].append(block % shards), rows["block"].append(block), rows["text"].append(None)
        rows["what"].append(np.array(covered, np.int64).tobytes())
    for k, have in out.items():
        what = np.empty(len(have), _STRETCH)
        what["key"], what["row"], what["start"], what["len"] = [h[0] for h in have], [h[1] for h in have], [h[2] for h in have], [len(h[3]) for h in have]
        what["doc"] = ids[what["row"]]
        rows["shard"].append(k), rows["block"].append(block), rows["what"].append(what.tobytes())
        rows["text"].append(b"".join(h[3] for h in have))
    return pa.table({"shard": pa.array(rows["shard"], pa.int32()), "block": pa.array(rows["block"], pa.int32()), "what": pa.array(rows["what"], pa.binary()), "text": pa.array(rows["text"], pa.binary())})


def _by_size(have: list[tuple], limit: int):
    """Lists of about `limit` bytes of text; one key's stay together."""
    part, size = [], 0
    for k, x in enumerate(have):
        if size >= limit and x[0] != have[k - 1][0]:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x[3])
    if part:
        yield part


def _sort_shard(key: tuple, table: pa.Table, *, s: SuffixSettings) -> pa.Table:
    """Spans that the shard's suffix arrays find covered, by block: (row, start, end)."""
    found: dict[int, list] = defaultdict(list)
    have: list[tuple[int, int, tuple[int, int, int], bytes]] = []
    for block, what, text in zip(table["block"].to_pylist(), table["what"].to_pylist(), table["text"].to_pylist(), strict=True):
        if text is None:
            found[block].append(np.frombuffer(what, np.int64).reshape(-1, 3))
            continue
        at = 0
        for k, doc, row, start, n in np.frombuffer(what, _STRETCH).tolist():
            have.append((k, doc, (block, row, start), text[at : at + n]))
            at += n
    have.sort(key=lambda x: (x[0], x[1]))
    kept: list[tuple] = []
    seen: dict[bytes, int] = {}
    last = None
    for x in have:
        if x[0] != last:
            last = x[0]
            seen.clear()
        if seen.setdefault(x[3], x[1]) < x[1]:
            block, row, start = x[2]
            found[block].append(np.array([[row, start, start + len(x[3])]], np.int64))
        else:
            kept.append(x)
    for part in _by_size(kept, s.chunk):
        for x, (held, _) in zip(part, _first_holders([p[3] for p in part], [p[1] for p in part], s), strict=True):
            if held:
                block, row, start = x[2]
                found[block].append(np.array([[row, start + a, start + z] for a, z in held], np.int64))
    return pa.table({"block": pa.array(list(found), pa.int32()), "spans": pa.array([np.concatenate(x).tobytes() for x in found.values()], pa.binary())})


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of spans [start, end), in order."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    head = np.flatnonzero(new)
    return np.column_stack([spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]])


def _cut(key: tuple, docs: pa.Table, covered: pa.Table, *, s: SuffixSettings, carry: tuple[str, ...], text: bool) -> pa.Table:
    b = _Block(docs, s)
    spans = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in covered["spans"].to_pylist()]
    every = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
    every = every[np.argsort(every[:, 0], kind="stable")]
    at = np.searchsorted(every[:, 0], np.arange(len(b.ids) + 1))
    raw = b.data.tobytes()
    n_bytes, n_removed, n_spans, digest, starts, ends, kept = [], [], [], [], [], [], []
    for k in range(len(b.ids)):
        own = raw[b.off[k] : b.off[k + 1]]
        out = merged(every[at[k] : at[k + 1], 1:]).tolist()
        if text:
            out = [x for x in (_whole_letters(own, *x) for x in out) if x[0] < x[1]]
        edge = [0, *(z for x in out for z in x), len(own)]
        rest = b"".join(own[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2))
        n_bytes.append(len(own)), n_spans.append(len(out)), n_removed.append(len(own) - len(rest))
        if text:
            kept.append(rest.decode("utf-8", "replace"))
        else:
            digest.append(hashlib.sha256(rest).hexdigest()), starts.append([x[0] for x in out]), ends.append([x[1] for x in out])
    out = {"doc_id": b.table["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64())}
    if text:
        out |= {"kept_text": pa.array(kept, pa.string())}
    else:
        out |= {"kept_sha256": pa.array(digest, pa.string()), "span_starts": pa.array(starts, pa.list_(pa.int64())), "span_ends": pa.array(ends, pa.list_(pa.int64()))}
    return pa.table(out | {f"c_{c}": b.table[f"c_{c}"] for c in carry})


def _whole_letters(own: bytes, a: int, z: int) -> tuple[int, int]:
    """The span without the parts of letters at its edges."""
    while a < z and own[a] & 0xC0 == 0x80:
        a += 1
    while z > a and z < len(own) and own[z] & 0xC0 == 0x80:
        z -= 1
    return a, z


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, settings: SuffixSettings | None = None, carry: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """Removes each byte covered by `settings.width` bytes that also start in a document with a smaller id.

    Returns per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and either kept_sha256, span_starts
    and span_ends, or, with `text`, kept_text. There, removed runs are narrowed to whole letters of UTF-8.
    carry: further columns of `docs` to pass through, as c_<name>.

    Passages are judged on the input. A null text is empty. Texts shorter than `width` lose nothing. Rows with one
    id don't take passages from each other; rows without an id come after all others. An empty table gives none.
    """
    s = settings or SuffixSettings()
    n = parts(docs)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), block_of(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))), s.blocks * n).alias("block"), *(F.col(c).alias(f"c_{c}") for c in carry))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    sent = d.groupBy("block").applyInArrow(by_key(_send, s=s, shards=n), "shard int, block int, data binary")
    answers = sent.groupBy("shard").applyInArrow(by_key(_answer), "block int, shard int, data binary")
    stretches = d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(by_key2(_stretches, s=s, shards=n), "shard int, block int, what binary, text binary")
    covered = stretches.groupBy("shard").applyInArrow(by_key(_sort_shard, s=s), "block int, spans binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_text string" if text else "kept_sha256 string, span_starts array<long>, span_ends array<long>")
    schema += "".join(f", `c_{c}` {kinds[f'c_{c}']}" for c in carry)
    return d.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(by_key2(_cut, s=s, carry=tuple(carry), text=text), schema)
