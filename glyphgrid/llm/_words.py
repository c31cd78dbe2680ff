"""Tokenising by distinct pieces of words, for tokenizers that treat such pieces apart from each other."""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from ._text import alike, lower_ascii, ragged, span_hashes, word_spans

_loaded: dict[tuple, WordTokenizer] = {}  # noqa: F821


# kinds of bytes: part of a Latin letter, digit, ASCII mark, and others, beside which no word is cut
_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 0
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _OTHER  # an apostrophe may begin a contraction


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte; of letters beyond ASCII only those of Latin of two bytes count as letters."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)) if len(data) else np.zeros(0, np.int64)
    low = data[lead + 1]  # not the signs for times and divided by, nor the dotted capital I, whose dot stands alone in lower case
    lead = lead[~((data[lead] == 0xC3) & ((low == 0x97) | (low == 0xB7)) | (data[lead] == 0xC4) & (low == 0xB0))]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def piece_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces, and whether one is letters only: words cut between letters, digits and marks, and
    between digits."""
    a, z = word_spans(data, off)
    if not len(a):
        return a, z, np.zeros(0, bool)
    kind = _kinds(data)
    cut = (kind[1:] != kind[:-1]) & (kind[1:] != _OTHER) & (kind[:-1] != _OTHER) | (kind[1:] == _DIGIT) & (kind[:-1] == _DIGIT)
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = cut
    start[off[1:-1]] = False
    inner = np.flatnonzero(start)
    start[:] = False
    start[inner] = True
    start[a] = True
    end = np.zeros(len(data) + 1, bool)
    end[inner] = True
    end[z] = True
    a, z = np.flatnonzero(start[:-1]), np.flatnonzero(end)
    letters = np.logical_and.reduceat(np.append(kind == _LETTER, False), np.column_stack([a, z]).ravel())[::2]
    return a, z, letters


class WordTokenizer:
    """Encodes batches of texts. Where the tokenizer drops white space, folds case and never looks across the borders of
    pieces, each distinct piece is encoded once and kept for later batches; else whole texts are encoded. At most
    `capacity` pieces are kept."""

    def __init__(self, path: str, capacity: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that byte-level models name by themselves
        rest = [b for b in range(256) if b not in keep]
        self.names = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = self._separable()
        self.direct = self.by_words and self._plain()
        self._clear()

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        """The process's own instance for a file; its words last over tasks."""
        key = (path, os.getpid())
        if key not in _loaded:
            _loaded[key] = cls(path)
        return _loaded[key]

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts, self.lengths, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _separable(self) -> bool:
        words = ["a", "The", "can't", "x's", "...", "don", "'t", "é", "éx", "12", "3rd", "A.B", "ß", "-", "word", "unhappiness,", "ΣΣ", "\u0301a", "Éa9.", "it's.", "x“y", "ÀB,cd!"]
        apart = dict(zip(words, self._ids(words), strict=True))
        for sep in (" ", "\n", "\t", "  ", "\r\n", " \x0b\x0c "):
            texts = [f"{a}{sep}{b}" for a in words for b in words]
            if self._ids(texts) != [apart[a] + apart[b] for a in words for b in words]:
                return False
            if self._ids([sep, sep + "a" + sep]) != [[], apart["a"]]:
                return False
        for w in (x + y for x in words for y in words):
            data = np.frombuffer(w.encode(), np.uint8)
            a, z, _ = piece_spans(data, np.array([0, len(data)]))
            low = lower_ascii(data).tobytes()
            if sum(self._ids([low[i:j].decode() for i, j in zip(a, z, strict=True)]), []) != self._ids([w])[0]:
                return False
        return True

    def _direct(self, word: str) -> list[int]:
        """Ids of a word of lower-case letters straight from the model."""
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.names))]

    def _plain(self) -> bool:
        words = ["a", "the", "unhappiness", "é", "été", "über", "straße", "niño", "œuvre", "čaj", "ǆ", "zzzzqx"]
        return [self._direct(w) for w in words] == self._ids(words)

    def _learn(self, pieces: list[bytes], letters: list[bool]) -> None:
        words = [x.decode("utf-8", "replace") for x in pieces]
        if self.direct:
            tokenize, names = self.tokenizer.model.tokenize, self.names
            # letters that one change of case makes two, or that aren't composed, are left to the whole tokenizer
            low = [w.lower() if x else None for w, x in zip(words, letters, strict=True)]
            easy = [w is not None and (w.isascii() or unicodedata.is_normalized("NFC", w) and len(w) == len(v) and w == w.lower()) for w, v in zip(low, words, strict=True)]
            rest = iter(self._ids([w for w, x in zip(words, easy, strict=True) if not x]))
            got = [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(names))] if x else next(rest) for w, x in zip(low, easy, strict=True)]
        else:
            got = self._ids(words)
        lengths = np.array([len(x) for x in got], np.int64)
        n, total = len(self.place), int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while n + len(got) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + total] = np.array([i for x in got for i in x], np.uint32)
        self.starts[n : n + len(got)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(got)] = lengths
        self.place.update(zip(pieces, range(n, n + len(got)), strict=True))
        self.used += total

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's), each text closed by `end_id` if given."""
        n, closing = len(off) - 1, [] if end_id is None else [end_id]
        raw = data.tobytes()
        whole = set(range(n)) if not self.by_words else self._with_added(raw, off)
        if not whole:
            return self._encode(data, off, end_id)
        apart = {k: ids + closing for k, ids in zip(sorted(whole), self._ids([raw[off[k] : off[k + 1]].decode("utf-8", "replace") for k in sorted(whole)]), strict=True)}
        if len(whole) == n:
            return np.array([i for x in apart.values() for i in x], np.uint32), np.array([len(x) for x in apart.values()], np.int64)
        ids, counts = self._encode(data, off, end_id)
        cut = np.append(0, np.cumsum(counts))
        parts = [np.array(apart[k], np.uint32) if k in apart else ids[cut[k] : cut[k + 1]] for k in range(n)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _with_added(self, raw: bytes, off: np.ndarray) -> set[int]:
        """Texts that hold the name of an added token, which the tokenizer looks for before all else."""
        found: set[int] = set()
        for name in self.added:
            at = raw.find(name)
            while at >= 0:
                found.add(int(np.searchsorted(off, at, "right")) - 1)
                at = raw.find(name, at + 1)
        return found

    def _encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        n, closing = len(off) - 1, int(end_id is not None)
        data = lower_ascii(data)
        a, z, letters = piece_spans(data, off)
        first = np.searchsorted(a, off)
        _, one, of = np.unique(span_hashes(data, a, z), return_index=True, return_inverse=True)
        if not alike(data, a, z, one[of]):  # two pieces of one hash
            raw = data.tobytes()
            one, of = np.unique(np.array([raw[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)], object), return_index=True, return_inverse=True)[1:]
        if len(self.place) + len(one) > self.capacity:
            self._clear()
        raw = data.tobytes()
        pieces = [raw[x:y] for x, y in zip(a[one].tolist(), z[one].tolist(), strict=True)]
        at = list(map(self.place.get, pieces))
        new = [k for k, x in enumerate(at) if x is None]
        if new:
            self._learn([pieces[k] for k in new], letters[one[new]].tolist())
            for k in new:
                at[k] = self.place[pieces[k]]
        which = np.array(at, np.int64)[of] if len(at) else np.zeros(0, np.int64)
        lengths = self.lengths[which]
        upto = np.append(0, np.cumsum(lengths))
        counts = np.diff(upto[first]) + closing
        out = np.full(int(counts.sum()), end_id if closing else 0, np.uint32)
        row = np.repeat(np.arange(n), np.diff(first))
        out[ragged(upto[:-1] + row * closing, lengths)] = self.ids[ragged(self.starts[which], lengths)]
        return out, counts
