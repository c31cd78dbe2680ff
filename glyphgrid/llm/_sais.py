"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of text.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller (LMS) substrings
are sorted by one inducing pass, named, sorted recursively where names repeat, and the whole array is induced
from them. The top level, whose alphabet is the 256 bytes plus two marks, induces a bucket at a time with array
operations; the recursion, whose alphabets are as large as their texts, induces over plain lists. Both are linear.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # never a byte of UTF-8


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = (t[1:] > t[:-1]).view(np.int8) - (t[1:] < t[:-1]).view(np.int8)
    step[-1] = 1
    settled = np.where(step != 0, np.arange(n), n - 1)
    settled = np.minimum.accumulate(settled[::-1])[::-1]
    return step[settled] > 0


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, np.int32)
    counts = np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    starts = ends - counts
    seed_at = np.searchsorted(t[seeds], np.arange(k + 1)) if len(seeds) else np.zeros(k + 1, np.int64)

    def push(batch: np.ndarray, larger: bool, edge: np.ndarray) -> None:
        j = batch - 1
        j = j[j >= 0]
        j = j[small[j] != larger]
        if not len(j):
            return
        c = t[j]
        if len(j) > 1:
            order = np.argsort(c, kind="stable")
            j, c = j[order], c[order]
        got = np.bincount(c, minlength=k)
        rank = np.arange(len(j)) - (np.cumsum(got) - got)[c]
        if larger:
            sa[edge[c] + rank] = j
            edge += got
        else:
            sa[edge[c] - 1 - rank] = j
            edge -= got

    head = starts.copy()
    for c in np.flatnonzero(counts):
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            batch = sa[done:upto]
            done = upto
            push(batch, True, head)
        push(seeds[seed_at[c] : seed_at[c + 1]], True, head)
    tail = ends.copy()
    sa[0] = n - 1
    for c in np.flatnonzero(counts)[::-1]:
        if c == 0:
            break
        done = ends[c]
        while done > tail[c]:
            upto = tail[c]
            batch = sa[upto:done][::-1]
            done = upto
            push(batch, False, tail)
        push(sa[starts[c] : head[c]][::-1], False, tail)
    return sa


def _names(t: np.ndarray, ordered: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each LMS substring in `ordered`; equal substrings share one. nexts: end of each, inclusive."""
    length = nexts - ordered + 1
    a, b = ordered[:-1], ordered[1:]
    differ = length[1:] != length[:-1]
    live = np.flatnonzero(~differ)
    at = 0
    while len(live):
        live = live[length[live] > at]
        same = t[a[live] + at] == t[b[live] + at]
        differ[live[~same]] = True
        live = live[same]
        at += 1
    rank = np.zeros(len(ordered), np.int64)
    np.cumsum(differ, out=rank[1:])
    return rank, int(rank[-1]) + 1


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of `t` (values below k), whose last value is a unique 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = lms[np.argsort(t[lms], kind="stable")].astype(np.int32)
    sa = _induce(t, small, seeds, k)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = sa[mark[sa]]
    nexts = np.empty(n, np.int32)
    nexts[lms[:-1]], nexts[lms[-1]] = lms[1:], n - 1
    rank, names = _names(t, ordered, nexts[ordered])
    if names < len(lms):
        place = np.empty(n, np.int32)
        place[lms] = np.arange(len(lms))
        reduced = np.empty(len(lms), np.int64)
        reduced[place[ordered]] = rank
        ordered = lms[_induced_list(reduced, names)].astype(np.int32)
    return _induce(t, small, ordered, k)


def _sorted_lms(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """LMS substrings in order, the rank of each (equal ones share one) and the number of ranks.

    With large alphabets they are short, so they are sorted by their letters and types, as many as fit a machine word
    at a time and only among those still equal. None is a proper prefix of another, since a type tells where one ends.
    """
    key = np.append(t * 2 + small + 1, 0).astype(np.uint64)
    length = np.diff(np.append(lms, len(t) - 1)) + 1
    bits, room = int(2 * k + 1).bit_length(), int(len(lms)).bit_length()
    step = max(1, (64 - room) // bits)
    rank = np.zeros(len(lms), np.int64)
    live, at = np.arange(len(lms)), 0
    while len(live):
        word = rank[live].astype(np.uint64)
        for c in range(at, at + step):
            word = (word << np.uint64(bits)) | key[np.where(length[live] > c, lms[live] + c, len(t))]
        order = np.argsort(word)
        x, word = live[order], word[order]
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(head, len(x)))
        # a rank is a place in the whole order, so that splitting a group moves no other
        old = rank[x]
        start = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        first = np.repeat(start, np.diff(np.append(start, len(x))))
        rank[x] = old + np.repeat(head - first[head], size)
        at += step
        live = x[np.repeat(size > 1, size)]
        live = live[length[live] > at]
    order = np.argsort(rank, kind="stable")
    names = np.cumsum(np.append(False, rank[order][1:] != rank[order][:-1]))
    return lms[order], names, int(names[-1]) + 1


def _induced_list(text: np.ndarray, k: int) -> np.ndarray:
    """The same algorithm over a large alphabet; the last value is a unique 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered, rank, names = _sorted_lms(text, small, lms, k)
    if names < len(lms):
        place = np.empty(n, np.int64)
        place[lms] = np.arange(len(lms))
        reduced = np.empty(len(lms), np.int64)
        reduced[place[ordered]] = rank
        ordered = lms[_induced_list(reduced, names)]
    counts = np.bincount(text, minlength=k)
    ends = np.cumsum(counts)
    # where the suffix before each goes, if it is larger (smaller) than its right neighbour; none for place -1
    before = np.empty(n + 1, np.int64)
    before[1:n], before[0], before[n] = text[:-1], -1, -1
    kind = np.zeros(n + 1, bool)
    kind[1:n] = small[:-1]
    larger, lesser = np.where(kind, -1, before).tolist(), np.where(kind, before, -1).tolist()
    sa = np.full(n, -1, np.int64)
    group = text[ordered]
    got = np.bincount(group, minlength=k)
    sa[ends[group] - np.repeat(np.cumsum(got), got) + np.arange(len(ordered))] = ordered
    sa = sa.tolist()
    edge = (ends - counts).tolist()
    for i in sa:
        c = larger[i]
        if c >= 0:
            sa[edge[c]] = i - 1
            edge[c] += 1
    edge = ends.tolist()
    for i in reversed(sa):
        c = lesser[i]
        if c >= 0:
            c_at = edge[c] = edge[c] - 1
            sa[c_at] = i - 1
    return np.array(sa, np.int64)


def permuted_lcp(raw: np.ndarray, sa: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): common prefix of each suffix with its predecessor in the array, by text position, cut where
    one of the two texts ends. left: bytes to the end of the text from each position.

    Only irreducible positions, where a text begins or the letters before the two suffixes differ, are compared;
    every other value is one less than the one at its left.
    """
    n = len(sa)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([raw, np.zeros(n + 16 - len(raw), np.uint8)])
    words = np.ndarray(n + 8, "<u8", padded, strides=(1,))
    here = np.arange(n)
    open_ = np.ones(n, bool)
    both = (here > 0) & (phi > 0)
    before = raw[here[both] - 1]
    open_[both] = (before != raw[phi[both] - 1]) | (before == SEPARATOR)
    a = np.flatnonzero(open_ & (phi >= 0))
    b = phi[a]
    got, live, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    most = np.minimum(left[a], left[b])
    while len(live):
        x = words[np.minimum(a[live] + at, n)] ^ words[np.minimum(b[live] + at, n)]
        stop = (x != 0) | (most[live] <= at + 8)
        end, y = live[stop], x[stop]
        low = y & (~y + np.uint64(1))
        same = np.where(y == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        got[end] = np.minimum(at + same, most[end])
        live = live[~stop]
        at += 8
    plcp = np.zeros(n, np.int64)
    plcp[a] = got
    last = np.maximum.accumulate(np.where(open_, here, 0))
    return plcp[last] - (here - last), phi


def repeated_first(raw: np.ndarray, ends: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each position of texts laid end to end, each closed by SEPARATOR: the least owner among all texts that
    hold the `width` bytes starting there; the text's own owner where fewer bytes are left.

    ends: of each text, the position of its separator. owner: an integer for each text.
    """
    n = len(raw) + 1
    t = np.zeros(n, np.uint16)
    t[:-1] = raw.astype(np.uint16) + 2
    t[ends] = 1
    sa = suffix_array(t, 258)
    text = np.zeros(len(raw), np.int64)
    text[ends[:-1] + 1] = 1
    text = np.cumsum(text)
    own = owner[text]
    left = np.zeros(n, np.int64)
    left[:-1] = ends[text] - np.arange(len(raw))
    plcp, _ = permuted_lcp(raw, sa, left)
    joined = plcp[sa] >= width
    group = np.flatnonzero(~joined)
    value = np.append(own, np.iinfo(np.int64).max)[sa]
    least = np.minimum.reduceat(value, group)
    out = np.empty(n, np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(group, n)))
    return np.where(left[:-1] >= width, out[:-1], own)
