"""Vectorised byte and word primitives shared by the text operators.

All functions work on a *batch*: the UTF-8 bytes of many texts laid end to end plus row offsets,
which is what an Arrow string column already is, so nothing is copied per row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on every other."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(2 * seed + 0x632BE59BD9B4E019))


_CODES = {s: byte_codes(s) for s in (0, 1)}


def column(col) -> pa.Array:
    """One contiguous Arrow array of a record batch's or a table's column."""
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def bytes_of(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    arr = column(col)
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_binary()) if pa.types.is_large_string(arr.type) else arr.cast(pa.binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    arr = arr.cast(pa.large_binary())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, limit: int = 1 << 19):
    """Row ranges whose texts hold about `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than blank, tab and line ends); none crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[1:-1]
    before[edge[edge < len(data)]] = False
    edge = edge[edge > 0] - 1
    after[edge] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), U64(base), U64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 8 << 20:
            _powers[base] = have
    return have[:n]


_INVERSE = pow(int(_BASE), -1, 1 << 64)


_PAD = np.zeros(8, np.uint8)
_KEYS = tuple(mix(np.arange(1, 5, dtype=U64) * _BASE + U64(0x243F6A8885A308D3)))
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Bytes of a span from which on a cryptographic hash takes it at once.
_LONG = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the data."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, _PAD]), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes, under a key of the seed. Eight bytes at a time go through a non-linear mix, so that
    no regular make-up of the bytes makes two spans alike; long spans take a keyed cryptographic hash."""
    n = ends - starts
    key = _KEYS[seed]
    look = eights(data)
    h = mix((look[starts] & _TAIL[np.minimum(n, 8)]) ^ (n.astype(U64) * U64(0xD6E8FEB86659FD93) + key))
    at, k = np.flatnonzero((n > 8) & (n <= _LONG)), 8
    while len(at):
        h[at] = mix((h[at] * U64(0x9FB21C651E98DF25) + key) ^ (look[starts[at] + k] & _TAIL[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    long = np.flatnonzero(n > _LONG)
    if len(long):
        secret, raw = int(key).to_bytes(8, "little"), memoryview(np.ascontiguousarray(data))
        h[long] = [int.from_bytes(hashlib.blake2b(raw[a:z], digest_size=8, key=secret).digest(), "little") for a, z in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, to: np.ndarray) -> bool:
    """Whether each span has the bytes of the span numbered `to`."""
    n = ends - starts
    if (n != n[to]).any():
        return False
    look = eights(data)
    at, k = np.flatnonzero(n <= _LONG), 0
    while len(at):
        if (((look[starts[at] + k] ^ look[starts[to[at]] + k]) & _TAIL[np.minimum(n[at] - k, 8)]) != 0).any():
            return False
        k += 8
        at = at[n[at] > k]
    return all(np.array_equal(data[starts[i] : ends[i]], data[starts[to[i]] : ends[to[i]]]) for i in np.flatnonzero(n > _LONG).tolist())


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a ^ (a >> U64(29))) * U64(0x9FB21C651E98DF25) + b)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive codes, by doubling, each step of it non-linear; length len(codes) - width + 1 (or none)."""
    if len(codes) < width:
        return np.zeros(0, U64)
    have, at, out, done = codes, 1, None, 0
    while True:
        if width & at:
            n = len(codes) - (done + at) + 1
            out = have[:n] if out is None else _joined(out[:n], have[done : done + n])
            done += at
        if done == width:
            return out if width > 1 else mix(out)
        n = len(codes) - 2 * at + 1
        have = _joined(have[:n], have[at : at + n])
        at *= 2


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every `width` consecutive codes, by doubling; length len(codes) - width + 1 (or none). Its
    collisions can be built on purpose, so it may choose what meets, never decide what is equal."""
    if len(codes) < width:
        return np.zeros(0, U64)
    base, have, at = int(_BASE), codes, 1
    out, done = None, 0
    while True:
        if width & at:
            n = len(codes) - (done + at) + 1
            if out is None:
                out = have[:n]
            else:
                out = out[:n] * U64(pow(base, at, 1 << 64)) + have[done : done + n]
            done += at
        if done == width:
            return out
        n = len(codes) - 2 * at + 1
        have = have[:n] * U64(pow(base, at, 1 << 64)) + have[at : at + n]
        at *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    if len(h) < width:
        return np.zeros(0, h.dtype)
    at = 1
    while 2 * at <= width:
        h = np.minimum(h[:-at], h[at:])
        at *= 2
    if rest := width - at:
        h = np.minimum(h[:-rest], h[rest:])
    return h


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def letter_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters (A-Z, a-z and all bytes beyond ASCII); none crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[1:-1]
    before[edge[edge < len(data)]] = False
    after[edge[edge > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Hasher:
    """Hashes of any spans of one text, from one pass over it, for numbers of features; see `rolling` for what it can't do."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.total = np.zeros(len(data) + 1, U64)
        np.cumsum(_CODES[seed][data] * _power(int(_BASE), len(data)), out=self.total[1:])
        self.down = _power(_INVERSE, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(U64))
