"""Katz backoff language model: counted, discounted, stored and evaluated in shards.

Texts are packed once into blocks of some megabytes, in a table bucketed by block, so that no later pass shuffles a text.
Order by order, a block asks the shards for what it needs: its distinct n-grams, each as the number of its context (an
(n-1)-gram) and of its last word, with their counts in the block's training texts. A shard adds the counts up, gives every
n-gram seen in training a number, writes its part of the order's table, and answers. What a context leaves to shorter ones
follows from its numbers of successors by count and the shorter probability of them, and from the discounts, which the
counts of counts of the whole order give. A block evaluates its tokens recursively: the longest n-gram seen, else the
context's weight times what the shorter context says.

N-grams of one context meet in one shard; a context so common that it would burden one is spread over several, and its sums
are added up behind them. There are at most `_SPLIT` such contexts of an order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import by_key, by_key2, give_back, parts, work_path
from ._text import U64, bytes_of, chunks, column, lower_ascii, mix, span_hashes, word_spans

#: Largest count that is discounted, by Good and Turing's estimate.
MOST = 5
#: Contexts with over one in so many tokens are spread over several shards.
_SPLIT = 16384
_END = mix(np.array([1], U64))[0]
_COUNTS = [f"n{r}" for r in range(1, MOST + 2)]
_NAMES = ["kind", "block", "shard", "data", "id", *_COUNTS, "tokens", "low"]
_SCHEMA = "kind int, block long, shard int, data binary, id long, " + ", ".join(f"{n} long" for n in _COUNTS) + ", tokens long, low double"
#: Kinds of rows that a shard writes: an answer to a block, its counts of counts, sums of a spread context, its part of the table.
_ANSWER, _TOTAL, _SPREAD, _TABLE = range(4)


@dataclass(frozen=True)
class KatzSettings:
    """order: length of the longest n-grams. block_bytes: bytes of text in a block, about."""

    order: int = 2
    block_bytes: int = 12 << 20


@dataclass
class Level:
    """One order as a whole: counts of counts 1 to MOST + 1, distinct n-grams, their tokens, and the spread contexts (number ->
    successors by count, shorter probability of them all)."""

    counts: list[int]
    types: int
    tokens: int
    spread: dict[int, tuple[list[int], float]] = field(default_factory=dict)

    def kept(self) -> np.ndarray:
        """Share of a count 0 to MOST that its n-gram keeps; where Good and Turing's estimate gives none below 1, all of it."""
        n, d = self.counts, np.ones(MOST + 1)
        rest = (MOST + 1) * n[MOST] / n[0] if n[0] else 1.0
        for r in range(1, MOST + 1):
            if rest < 1 and n[r - 1]:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest)
                d[r] = x if 0 < x < 1 else 1.0
        return d


def _pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one compressed value; bytes of numbers are laid out by their place, so that the high ones fall together."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))], np.int64)
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in map(np.ascontiguousarray, arrays) if len(a))
    return zstandard.compress(head.tobytes() + body, level)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for size, kind in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        dtype = np.dtype(chr(kind))
        flat = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at)
        out.append(np.ascontiguousarray(flat.reshape(dtype.itemsize, size).T).view(dtype).ravel())
        at += size * dtype.itemsize
    return out


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, of which there are few, and the place of each among them."""
    lows, which = np.unique(values, return_inverse=True)
    return which.astype(np.uint32), lows


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _within(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Words that ascend within each context, as steps there."""
    steps, head = _steps(word), _heads(context)
    steps[head] = word[head]
    return steps


def _whole(context: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The words that `_within` gave steps of."""
    head, total = _heads(context), np.cumsum(steps, dtype=U64)
    return total - np.repeat(total[head] - steps[head], np.diff(np.append(head, len(steps))))


def _heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that are in order."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])))


def _blocks(size: int):
    """Rows (doc_id, text, train) as packed blocks (block, data); a block's number is made of its partition's and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, length = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            data = _pack(*(np.concatenate(x) for x in zip(*held, strict=True)), level=6)
            return pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

        for batch in batches:
            data, off = bytes_of(batch["text"])
            doc = column(batch["doc_id"])
            null = doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            doc = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            train = column(batch["train"]).to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, j in chunks(off, size // 4):
                held.append((doc[i:j], null[i:j], train[i:j], np.diff(off[i : j + 1]), data[off[i] : off[j]]))
                length += int(off[j] - off[i])
                if length >= size:
                    yield block()
                    n, held, length = n + 1, [], 0
        if held:
            yield block()
        del held
        give_back()

    return run


class _Tokens:
    """The tokens of a block: hashes of lower-cased words, each text closed by the end token."""

    def __init__(self, data: bytes):
        self.doc, null, train, length, raw = _unpack(data)
        self.null, train = null.astype(bool), train.astype(bool)
        off = np.append(0, np.cumsum(length))
        low = lower_ascii(raw)
        a, z = word_spans(low, off)
        words = np.diff(np.searchsorted(a, off))
        self.counts = words + 1
        self.start = np.append(0, np.cumsum(self.counts))
        self.token = np.full(int(self.start[-1]), _END, U64)
        if len(a):
            self.token[np.arange(len(a)) + np.repeat(np.arange(len(words)), words)] = span_hashes(low, a, z)
        self.place = (np.arange(len(self.token)) - np.repeat(self.start[:-1], self.counts)).astype(np.int32)
        self.train = np.repeat(train, self.counts)


def _local(context: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Contexts as a shard numbers them: its own ones, whose number has its remainder, without gaps, then those spread to it."""
    s = U64(shards)
    return ((context + s - shard.astype(U64)) % s) << U64(44) | context // s


def _global(local: np.ndarray, shard, shards: int) -> np.ndarray:
    s = U64(shards)
    return (local & U64((1 << 44) - 1)) * s + ((local >> U64(44)) + np.asarray(shard).astype(U64)) % s


@dataclass
class _Asked:
    """Contexts are in their shard's numbers. A block's distinct n-grams in order of shard, context and word; n counts them in training texts, low is their probability
    by the shorter context, `of` their place for each token (-1: none asked), spread marks contexts that several shards hold."""

    shard: np.ndarray
    context: np.ndarray
    word: np.ndarray
    n: np.ndarray
    low: np.ndarray
    spread: np.ndarray
    of: np.ndarray


class _Known:
    """A block's tokens and what the shards have answered. For the orders so far: the number of the n-gram that ends at each token
    (-1: training has not seen it, or the text is too short) and its count; and each token's probability by the longest of them."""

    def __init__(self, data: bytes, answers: list[tuple[int, int, bytes]], levels: list[Level], shards: int):
        self.t, self.levels, self.shards = _Tokens(data), levels, shards
        self.number: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.prob = np.zeros(len(self.t.token))
        for k, level in enumerate(levels, 1):
            self._learn(k, level, {shard: got for order, shard, got in answers if order == k})

    def asked(self, k: int) -> _Asked:
        t, shards = self.t, U64(self.shards)
        if k == 1:
            at = np.arange(len(t.token))
            context, word, spread = np.zeros(len(at), U64), t.token, np.zeros(len(at), bool)
            shard = (word % shards).astype(np.int32)
        else:
            # only after contexts that training has seen; all words that it hasn't are one
            at = np.flatnonzero(t.place >= k - 1)
            at = at[self.number[k - 2][at - 1] >= 0]
            context, word = self.number[k - 2][at - 1].astype(U64), self.number[0][at].view(U64)
            over = -(-self.count[k - 2][at - 1] // max(4096, self.levels[0].tokens // _SPLIT))
            spread = over > 1
            salt = np.where(spread, mix(word) % np.maximum(np.minimum(over, self.shards), 1).astype(U64), U64(0))
            shard = ((context + salt) % shards).astype(np.int32)
            context = _local(context, shard, self.shards)
            del over, salt
        order = np.lexsort((word, context, shard))
        s, c, w = shard[order], context[order], word[order]
        head = _heads(s, c, w)
        s, c, w = s[head], c[head], w[head]
        number = np.repeat(np.arange(len(head), dtype=np.int32), np.diff(np.append(head, len(order))))
        at = at[order]
        of = np.full(len(t.token), -1, np.int32)
        of[at] = number
        n = np.bincount(number, t.train[at], len(head)).astype(np.int64)
        return _Asked(s, c, w, n, self.prob[at[head]], spread[order[head]], of)

    def _learn(self, k: int, level: Level, answers: dict[int, bytes]) -> None:
        a, keep = self.asked(k), level.kept()
        m = len(a.shard)
        number, count = np.full(m, -1, np.int64), np.zeros(m, np.int64)
        some, left, low = np.zeros(m, np.uint8), np.zeros((m, MOST), np.int64), np.zeros(m)
        bounds = np.searchsorted(a.shard, np.arange(self.shards + 1))
        for s, data in answers.items():
            i, j = int(bounds[s]), int(bounds[s + 1])
            others, rank, *told = _unpack(data)
            count[i:j] = total = others + a.n[i:j]
            if len(rank):
                found = np.flatnonzero(total)
                if k == 1:
                    found = found[_by_size(total[found])]
                number[i + found] = np.cumsum(rank.astype(np.int64)) * self.shards + s
            if k > 1:
                mask, sums, lows = told
                some[i:j] = mask[_numbered(a.context[i:j])]
                missing = i + np.flatnonzero(total == 0)
                which = _numbered(a.context[missing])
                left[missing], low[missing] = sums.reshape(-1, MOST)[which], lows[which]
        at = np.flatnonzero(a.spread)
        if len(at):
            ids, which = np.unique(_global(a.context[at], a.shard[at], self.shards), return_inverse=True)
            sums = [level.spread[i] for i in ids.tolist()]
            left[at], low[at] = np.array([x for x, _ in sums])[which], np.array([x for _, x in sums])[which]
            some[at] = _mask(left[at])
        have = a.of >= 0
        self.number.append(np.where(have, number[a.of], -1) if m else np.full(len(have), -1))
        self.count.append(np.where(have, count[a.of], 0) if m else np.zeros(len(have), np.int64))
        kept = count * np.where(count <= MOST, keep[np.minimum(count, MOST)], 1.0)
        if k == 1:
            whole, spare = unigram_mass(level)
            self.prob = np.where(count > 0, kept / whole, spare)[a.of] if m else self.prob
            return
        at = np.flatnonzero(have)
        of = a.of[at]
        discounted = np.uint8(sum(1 << (r - 1) for r in range(1, MOST + 1) if keep[r] < 1))
        weight, whole = backoff_weight(self.count[k - 2][at - 1], (some & discounted != 0)[of], left[of], low[of], keep)
        self.prob = self.prob.copy()
        self.prob[at] = np.where(count[of] > 0, kept[of] / whole, weight * self.prob[at])


def unigram_mass(level: Level) -> tuple[float, float]:
    """Divisor of the words' kept counts, and the probability of a word that training has not seen."""
    lost = float(sum(r * n * (1 - d) for r, n, d in zip(range(1, MOST + 1), level.counts, level.kept()[1:], strict=False)))
    whole = level.tokens + (lost == 0)
    return float(whole), (lost or 1.0) / whole


def backoff_weight(count: np.ndarray, loses: np.ndarray, left: np.ndarray, low: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of contexts for words that never followed them, and the divisor of their successors' counts. A context whose
    successors lose nothing counts one more. The weight is what they lose, over the shorter probability of all other words."""
    lost = (left * np.arange(1, MOST + 1) * (1 - kept[1:])).sum(axis=1)
    whole = count + np.where(loses, 0.0, 1.0)
    return np.where(loses, lost, 1.0) / whole / np.maximum(1 - low, 1e-12), whole


def _numbered(sorted_: np.ndarray) -> np.ndarray:
    """Number of each value among the distinct ones."""
    head = _heads(sorted_)
    return np.repeat(np.arange(len(head)), np.diff(np.append(head, len(sorted_))))


def _by_size(count: np.ndarray) -> np.ndarray:
    """An order by powers of two of counts, larger ones first. Words are numbered so, since common ones then have low numbers, which
    pack well; who knows the counts knows the order."""
    return np.argsort(-np.frexp(count.astype(np.float64))[1], kind="stable")


def _numbered_any(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _mask(left: np.ndarray) -> np.ndarray:
    """A bit for each count that successors have."""
    return ((left > 0) << np.arange(MOST)).sum(axis=1).astype(np.uint8)


def _ask(key: tuple, blocks: pa.Table, answers: pa.Table, *, levels: list[Level], shards: int) -> pa.Table:
    """A block's request to each shard."""
    sent = [(k, s, x) for k, s, x in zip(*(answers[c].to_pylist() for c in ("k", "shard", "data")), strict=True)]
    a = _Known(blocks["data"][0].as_py(), sent, levels, shards).asked(len(levels) + 1)
    bounds = np.searchsorted(a.shard, np.arange(shards + 1))
    some = np.flatnonzero(np.diff(bounds))
    data = []
    for s in some.tolist():
        x = slice(int(bounds[s]), int(bounds[s + 1]))
        low = a.low[x][a.n[x] > 0]
        if len(levels) < 2:
            # what a word pair has by its shorter context is the word's own: sent once a word
            low = low[np.unique(a.word[x][a.n[x] > 0], return_index=True)[1]]
        # all words that a shard is asked for have one remainder
        word = a.word[x] if levels else a.word[x] // U64(shards)
        data.append(_pack(_steps(a.context[x]), _within(a.context[x], word), a.n[x].astype(np.uint32), *_coded(low), np.unique(a.context[x][a.spread[x]])))
    return pa.table({"shard": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), key[0].as_py(), np.int64)), "data": pa.array(data, pa.binary())})


def _meet(key: tuple, table: pa.Table, *, k: int, last: bool, shards: int) -> pa.Table:
    """A shard's n-grams of order k: its rows of each kind. A block is told the counts in all other blocks; of the last order no numbers
    are told, as nothing asks for them."""
    blocks = table["block"].to_pylist()
    own = key[0].as_py()
    sent = [_unpack(x) for x in table["data"].to_pylist()]
    for x in sent:
        x[0] = np.cumsum(x[0], dtype=U64)
        x[1] = _whole(x[0], x[1]) if k > 1 else _whole(x[0], x[1]) * U64(shards) + U64(own)
    context = np.concatenate([x[0] for x in sent])
    word, n = np.concatenate([x[1] for x in sent]), np.concatenate([x[2] for x in sent]).astype(np.int64)
    low = np.zeros(len(n))
    low[n > 0] = np.concatenate([x[4][x[3]][_numbered_any(x[1][x[2] > 0]) if k < 3 else slice(None)] for x in sent])
    spread = np.unique(np.concatenate([x[5] for x in sent]))
    cut = np.cumsum([0, *(len(x[0]) for x in sent)])
    order = np.lexsort((word, context))
    head = _heads(context[order], word[order])
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    total, low = np.add.reduceat(n[order], head), np.maximum.reduceat(low[order], head)
    context, word = context[order][head], word[order][head]
    del order
    seen = total > 0
    order = _by_size(total[seen]) if k == 1 else np.arange(int(seen.sum()))
    rank = np.zeros(len(seen), np.int64)
    rank[np.flatnonzero(seen)[order]] = np.arange(len(order))
    first = _heads(context)
    group = _numbered(context)
    left = np.stack([np.add.reduceat(total == r, first).astype(np.int64) for r in range(1, MOST + 1)], axis=1)
    below = np.add.reduceat(np.where(seen, low, 0.0), first)
    mask = _mask(left)
    rows = []
    for i, block in enumerate(blocks):
        g = of[cut[i] : cut[i + 1]]
        missing = group[g[~seen[g]]]
        missing = missing[_heads(missing)]
        told = (mask[group[g[_heads(context[g])]]], left[missing].ravel().astype(np.int32), below[missing]) if k > 1 else ()
        rows.append((_ANSWER, block, _pack((total[g] - n[cut[i] : cut[i + 1]]).astype(np.uint32), _steps(np.sort(rank[g[seen[g]][: 0 if last else None]])).astype(np.uint32), *told), None, [0] * len(_COUNTS), 0, 0.0))
    rows.append((_TOTAL, None, None, int(seen.sum()), [int((total == r).sum()) for r in range(1, MOST + 2)], int(total.sum()), 0.0))
    for g in np.searchsorted(context[first], spread).tolist():
        rows.append((_SPREAD, None, None, int(_global(context[first[g : g + 1]], own, shards)[0]), [*left[g].tolist(), 0], 0, float(below[g])))
    trained = np.unique(group[seen])
    rows.append((_TABLE, None, _pack(_steps(context[seen]), _within(context[seen], word[seen][order]), total[seen][order], left[trained].ravel(), *_coded(below[trained])), None, [0] * len(_COUNTS), 0, 0.0))
    kind, block, data, number, counts, tokens, lows = zip(*rows, strict=True)
    fields = [pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array([own] * len(rows), pa.int32()), pa.array(data, pa.binary()), pa.array(number, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(tokens, pa.int64()), pa.array(lows, pa.float64())]
    return pa.table(fields, names=_NAMES)


def _score(key: tuple, blocks: pa.Table, answers: pa.Table, *, levels: list[Level], shards: int) -> pa.Table:
    sent = [(k, s, x) for k, s, x in zip(*(answers[c].to_pylist() for c in ("k", "shard", "data")), strict=True)]
    b = _Known(blocks["data"][0].as_py(), sent, levels, shards)
    t, first = b.t, levels[0]
    base = np.log10((b.count[0] + 0.5) / (first.tokens + 0.5 * (first.types + 1)))
    sums = {"n_known": (b.count[0] > 0).astype(np.int64), "base_score": base, "score": np.log10(b.prob)}
    out = {c: np.add.reduceat(x, t.start[:-1]) if len(t.doc) else x[:0] for c, x in sums.items()}
    trained = t.train[t.start[:-1]]
    return pa.table({"doc_id": pa.array(t.doc, pa.int64(), mask=t.null), "trained": pa.array(trained), "n_tokens": pa.array(t.counts.astype(np.int64)), **{c: pa.array(x) for c, x in out.items()}})


class KatzModel:
    """A model of the texts it was made from: `levels`, and the shards' parts of the n-gram tables, a folder for each order."""

    def __init__(self, docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", settings: KatzSettings | None = None):
        s = settings or KatzSettings()
        self.spark, self.shards, self.levels, self.tables = docs.sparkSession, parts(docs), [], []
        self._blocks = self._packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train")), s)
        for k in range(1, s.order + 1):
            asked = self._met(_ask, "shard int, block long, data binary")
            path = work_path(self.spark, f"grams-{k}")
            asked.groupBy("shard").applyInArrow(by_key(_meet, k=k, last=k == s.order, shards=self.shards), _SCHEMA).write.option("compression", "zstd").partitionBy("kind").parquet(path)
            self.tables.append(self.spark.read.schema(_SCHEMA).parquet(path))
            self.levels.append(self._level(self.tables[-1]))

    def _packed(self, d: DataFrame, s: KatzSettings) -> DataFrame:
        """The blocks, bucketed as the answers to them will be partitioned."""
        name = f"katz_{uuid.uuid4().hex}"
        buckets = min(100_000, max(self.shards, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        packed = d.mapInArrow(_blocks(s.block_bytes), "block long, data binary")
        packed.write.format("parquet").bucketBy(buckets, "block").option("path", work_path(self.spark, "texts")).option("compression", "none").saveAsTable(name)
        found = self.spark.table(name)
        found.schema  # noqa: B018 - the plan is made before the name goes; the files stay
        self.spark.sql(f"DROP TABLE {name}")
        return found

    def _met(self, fn, schema: str) -> DataFrame:
        """`fn` of each block and of the answers so far to it."""
        answers = self.spark.createDataFrame([], "block long, k int, shard int, data binary")
        for k, t in enumerate(self.tables, 1):
            answers = answers.unionByName(t.where(F.col("kind") == _ANSWER).select("block", F.lit(k).alias("k"), "shard", "data"))
        return self._blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(by_key2(fn, levels=self.levels, shards=self.shards), schema)

    def _level(self, t: DataFrame) -> Level:
        x = t.where(F.col("kind") == _TOTAL).agg(*(F.sum(c).alias(c) for c in ("id", "tokens", *_COUNTS))).first()
        spread = t.where(F.col("kind") == _SPREAD).groupBy("id").agg(*(F.sum(c).alias(c) for c in (*_COUNTS[:MOST], "low")))
        # at most _SPLIT rows: each stands for one in so many tokens
        found = {r["id"]: ([r[c] for c in _COUNTS[:MOST]], r["low"]) for r in spread.collect()}
        return Level([x[c] or 0 for c in _COUNTS], x["id"] or 0, x["tokens"] or 0, found)

    def ngrams(self, k: int) -> DataFrame:
        """The table of order k, a row for each n-gram seen in training: number, context (the number of the (k-1)-gram before its
        last word; 0 for k = 1), word (the word's number; for k = 1 its hash), count."""
        shards = self.shards

        def run(batches):
            for batch in batches:
                for shard, data in zip(batch["shard"].to_pylist(), batch["data"].to_pylist(), strict=True):
                    steps, word, count, *_ = _unpack(data)
                    local = np.cumsum(steps, dtype=U64)
                    word = _whole(local, word)
                    context = _global(local, shard, shards).view(np.int64) if k > 1 else np.zeros(len(steps), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(word)) * shards + shard, pa.int64()), pa.array(context), pa.array(word.view(np.int64)), pa.array(count, pa.int64())], names=["number", "context", "word", "count"])

        return self.tables[k - 1].where(F.col("kind") == _TABLE).select("shard", "data").mapInArrow(run, "number long, context long, word long, count long")

    def contexts(self, k: int) -> DataFrame:
        """What contexts of the n-grams of order k leave to shorter ones: context, n1 to n5 (successors by count), low (the shorter
        probability of all successors). A spread context has a row in each of its shards, to be added up."""

        shards = self.shards

        def run(batches):
            for batch in batches:
                for shard, data in zip(batch["shard"].to_pylist(), batch["data"].to_pylist(), strict=True):
                    steps, _, _, left, at, lows = _unpack(data)
                    context = _global(np.cumsum(steps, dtype=U64), shard, shards)
                    left = left.reshape(-1, MOST)
                    yield pa.RecordBatch.from_arrays([pa.array(context[_heads(context)].view(np.int64)), *(pa.array(left[:, r]) for r in range(MOST)), pa.array(lows[at])], names=["context", *_COUNTS[:MOST], "low"])

        return self.tables[k - 1].where(F.col("kind") == _TABLE).select("shard", "data").mapInArrow(run, "context long, " + ", ".join(f"{n} long" for n in _COUNTS[:MOST]) + ", low double")

    def scores(self) -> DataFrame:
        """Per text: doc_id, trained, n_tokens, n_known, base_score, score."""
        return self._met(_score, "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, settings: KatzSettings | None = None) -> DataFrame:
    """Scores every text by a Katz backoff model of the texts that `train` marks.

    Returns per row: doc_id, trained, n_tokens (words and one end), n_known (tokens that training has seen), train_tokens,
    base_score (log10 probability by words alone, each count raised by one half) and score (log10 probability by the
    model). Words are runs of bytes other than blank, tab, line and page ends, A-Z lower-cased, told apart by 64-bit
    hashes. Counts up to five are discounted; for each context the probabilities of all words and of one unknown word
    add up to 1.

    A null or empty text is an end alone. A null mark is no mark. Rows of one id are texts of their own. Without any training
    text every token is unknown and of probability 1. An empty table gives no rows.
    """
    model = KatzModel(docs, train, id_col, text_col, settings)
    return model.scores().withColumn("train_tokens", F.lit(model.levels[0].tokens).cast("long"))
