"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters in lower case; their features are the word, its head and its tail, hashed. The field is
trained on the driver from a bounded sample of labelled documents: tokens of toxic documents count as toxic where the
word is far commoner in toxic than in other documents, judged on the same sample by the distinct surroundings it has there. Forward-backward marginals give each
token's probability; a logistic model of their sum and maximum, fitted on documents that the field wasn't trained on,
gives the document's score, and runs of tokens above one half its offending spans.

The recursions run over all documents of a batch at once: segments of fixed length are reduced to 2 x 2 products, the
products are chained over each document, and the segments are then filled in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import give_back, written
from ._text import U64, Hasher, bytes_of, chunks, letter_spans, lower_ascii, mix, ragged

_SEGMENT = 64
#: Probability from which a token counts for its document.
_LIKELY = 0.1
#: Tokens of the training sample that are worked on at a time.
_PART = 1 << 17


@dataclass(frozen=True)
class ToxicitySettings:
    """toxic_sample, clean_sample: labelled documents at most of each kind that the model is fitted on, those of least
    hash. text_bytes, sample_bytes: bytes of a text, and of all texts, at most; the first ones by hash that fit. least_contexts, least_odds:
    surroundings that a word has in toxic documents, and its log odds by them, from which its tokens count as toxic;
    copies of a passage give the same surroundings and so count once. fit_tokens: tokens at most that the field's weights are
    trained on, in documents of a sixteenth of it at most. bits: binary logarithm of the feature table.
    rounds, rate, decay: of the training. fold: one in so many documents is held out, by the checksum of its id."""

    toxic_sample: int = 2500
    clean_sample: int = 5000
    text_bytes: int = 1 << 14
    sample_bytes: int = 12 << 20
    least_contexts: int = 4
    least_odds: float = 2.5
    fit_tokens: int = 1 << 20
    bits: int = 18
    rounds: int = 30
    rate: float = 0.3
    decay: float = 1e-6
    fold: int = 5


@dataclass
class CrfModel:
    weights: np.ndarray  # of each feature, for the toxic tag
    bias: float
    transitions: np.ndarray  # log potential [from, to]
    logistic: np.ndarray  # of a document's features
    bits: int


def token_features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, first token of each row, and (3, tokens) feature numbers."""
    low = lower_ascii(data)
    a, z = letter_spans(low, off)
    h = Hasher(low)
    down = U64(64 - bits)
    features = np.empty((3, len(a)), np.int32)
    features[0] = h(a, z) >> down
    features[1] = (h(a, np.minimum(z, a + 6)) * U64(0x9E3779B97F4A7C15)) >> down
    features[2] = (h(np.maximum(a, z - 5), z) * U64(0xC2B2AE3D27D4EB4F)) >> down
    return a, z, np.searchsorted(a, off), features


def _surroundings(data: np.ndarray, off: np.ndarray, a: np.ndarray, z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the twelve bytes of its text before and behind each token."""
    h = Hasher(lower_ascii(data))
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return mix(h(np.maximum(a - 12, off[row]), a) * U64(0x9E3779B97F4A7C15) + h(z, np.minimum(z + 12, off[row + 1])))


def _segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, place in its document, document) of each segment."""
    n = np.diff(first)
    k = -(-n // _SEGMENT)
    doc = np.repeat(np.arange(len(n)), k)
    place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    start = first[:-1][doc] + place * _SEGMENT
    return start, np.minimum(_SEGMENT, first[1:][doc] - start), place, doc


def marginals(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Probability of the toxic tag of each token of documents that begin at tokens `first`; with `pairs`, also the expected transitions.

    With two tags, a message is the ratio of its two parts. Segments are ordered by length, so that those with a k-th token
    come first."""
    expected = np.zeros((2, 2))
    if not len(score):
        return (score, expected) if pairs else score
    (t00, t01), (t10, t11) = np.exp(transitions)
    start, length, place, doc = _segments(first)
    by = np.argsort(-length, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    start, length, head = start[by], length[by], place[by] == 0
    live = np.searchsorted(-length, -np.arange(_SEGMENT))  # segments longer than k
    at = np.minimum(start[None, :] + np.arange(_SEGMENT)[:, None], len(score) - 1)
    w = np.exp(np.clip(score, -30, 30))[at]
    # products of the segments' step matrices; the first token of a document has no step before it
    a, b = np.where(head, 1, t00), np.where(head, 0, t01 * w[0])
    c, d = np.where(head, 0, t10), np.where(head, w[0], t11 * w[0])
    into, onto = np.ones(len(by)), np.ones(len(by))
    if int(place.max()):
        for k in range(1, _SEGMENT):
            n = live[k]
            u, v, x, y = a[:n], b[:n], c[:n], d[:n]
            u, v, x, y = u * t00 + v * t10, (u * t01 + v * t11) * w[k, :n], x * t00 + y * t10, (x * t01 + y * t11) * w[k, :n]
            z = 1 / (u + v + x + y)
            a[:n], b[:n], c[:n], d[:n] = u * z, v * z, x * z, y * z
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(int(place.max()) + 2))
        for k in range(1, len(bounds) - 1):
            s = order[bounds[k] : bounds[k + 1]]
            now, before = rank[s], rank[s - 1]
            r = into[before]
            into[now] = (b[before] + r * d[before]) / (a[before] + r * c[before])
        for k in range(len(bounds) - 2, 0, -1):
            s = order[bounds[k] : bounds[k + 1]]
            now, before = rank[s], rank[s - 1]
            r = onto[now]
            onto[before] = (c[now] + d[now] * r) / (a[now] + b[now] * r)
    forward = np.empty((_SEGMENT, len(by)))
    r = forward[0] = np.where(head, into, (t01 + into * t11) / (t00 + into * t10)) * w[0]
    for k in range(1, _SEGMENT):
        r = r[: live[k]]
        r = forward[k, : live[k]] = (t01 + r * t11) / (t00 + r * t10) * w[k, : live[k]]
    out = np.empty(len(score))
    for k in range(_SEGMENT - 1, -1, -1):
        n = live[k]
        o = onto[:n]
        both = forward[k, :n] * o
        out[at[k, :n]] = both / (1 + both)
        pot = w[k, :n] * o
        if pairs:
            left = forward[k - 1, :n] if k else into
            x01, x10, x11 = t01 * pot, t10 * left, t11 * left * pot
            z = 1 / (t00 + x01 + x10 + x11)
            if not k:
                z = np.where(head, 0, z)
            expected += [[t00 * z.sum(), (x01 * z).sum()], [(x10 * z).sum(), (x11 * z).sum()]]
        onto[:n] = (t10 + t11 * pot) / (t00 + t01 * pot)
    return (out, expected) if pairs else out


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, 4): one; the expected toxic tokens, of those that are likely at all, as n / (1 + n), so that a long text
    doesn't add up to a toxic one; log of their share; and the largest probability."""
    n = np.diff(first)
    out = np.zeros((len(n), 4))
    out[:, 0] = 1
    some = np.flatnonzero(n)
    if len(some):
        total = np.add.reduceat(np.where(p >= _LIKELY, p, 0), first[:-1][some])
        out[some, 1] = total / (1 + total)
        out[some, 2] = np.log1p(1000 * total / n[some])
        out[some, 3] = np.maximum.reduceat(p, first[:-1][some])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str | None], toxic: list[int], s: ToxicitySettings) -> CrfModel:
    """Fits the field on four fifths of the documents and the logistic model on the rest; one kind alone, or none, gives a
    model that scores all documents with that kind's share."""
    y = np.array(toxic, np.int64)
    size = 1 << s.bits
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return CrfModel(np.zeros(size, np.float32), -9.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]), s.bits)
    data, off = bytes_of(pa.array(texts, pa.string()))
    got = []
    for i, j in chunks(off, 1 << 18):
        own, local = data[off[i] : off[j]], off[i : j + 1] - off[i]
        a, z, n, f = token_features(own, local, s.bits)
        got.append((n, f, _surroundings(own, local, a, z, n)))
    first = np.append(0, np.cumsum(np.concatenate([np.diff(x) for x, _, _ in got])))
    features = np.concatenate([x for _, x, _ in got], axis=1)
    around = np.concatenate([x for _, _, x in got])
    del got
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(first))
    fit = np.arange(len(y)) % 5 != 4
    # distinct contexts of each word in documents of each kind
    toxic_token = y.astype(bool)[doc]
    around &= ~U64(2 * size - 1)
    around |= features[0].astype(U64)
    around[toxic_token] |= U64(size)
    seen = around[fit[doc]]
    del around, data
    seen.sort()
    seen = seen[np.append(True, seen[1:] != seen[:-1])] if len(seen) else seen
    seen = (seen & U64(2 * size - 1)).astype(np.int32)  # kind and word
    d1 = np.bincount(seen[seen >= size] - size, minlength=size)
    d0 = np.bincount(seen[seen < size], minlength=size)
    n1, n0 = int(d1.sum()), int(d0.sum())
    del seen
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    known = (odds >= s.least_odds) & (d1 >= s.least_contexts)
    tag = known[features[0]] & toxic_token
    # train on documents of the first four fifths, as many as the bound allows
    n = np.diff(first)
    taken = fit & (n <= s.fit_tokens // 16)
    taken &= np.cumsum(n * taken) <= s.fit_tokens
    use = taken[doc]
    f, g = features[:, use], tag[use].astype(np.float64)
    del use, tag, toxic_token, doc
    n = n[taken]
    begin = np.append(0, np.cumsum(n))
    w, bias, trans = np.zeros(size), -4.0, np.array([[1.0, -1.0], [0.0, 0.0]])
    seen_pairs = np.zeros((2, 2))
    inner = np.ones(len(g), bool)
    inner[begin[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    np.add.at(seen_pairs, (g[at - 1].astype(int), g[at].astype(int)), 1)
    slope, slope_b, slope_t = np.zeros(size), 0.0, np.zeros((2, 2))
    scale = 1 / max(1.0, g.sum())
    # a part of the documents at a time, so that memory doesn't depend on the sample's size
    parts = np.searchsorted(begin, np.arange(0, len(g) + _PART, _PART))
    parts = np.unique(np.append(np.minimum(parts, len(begin) - 1), [0, len(begin) - 1]))
    for _ in range(s.rounds):
        d, expected = np.empty(len(g)), np.zeros((2, 2))
        for i, j in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
            a, z = int(begin[i]), int(begin[j])
            p, more = marginals(w[f[0, a:z]] + w[f[1, a:z]] + w[f[2, a:z]] + bias, begin[i : j + 1] - a, trans, pairs=True)
            d[a:z] = (g[a:z] - p) * scale
            expected += more
        grad = sum(np.bincount(f[i], weights=d, minlength=size) for i in range(3)) - s.decay * w
        # per-weight steps by the running square of its slope
        slope += grad**2
        slope_b += d.sum() ** 2
        gt = (seen_pairs - expected) * scale
        slope_t += gt**2
        w += s.rate * grad / np.sqrt(slope + 1e-12)
        bias += s.rate * d.sum() / np.sqrt(slope_b + 1e-12)
        trans = trans + 0.3 * s.rate * gt / np.sqrt(slope_t + 1e-12)
    model = CrfModel(w.astype(np.float32), float(bias), trans, np.zeros(4), s.bits)
    rest = np.flatnonzero(~fit)
    x = []
    for i in range(0, len(rest), 200):
        some = rest[i : i + 200]
        at = ragged(first[:-1][some], np.diff(first)[some])
        own = np.append(0, np.cumsum(np.diff(first)[some]))
        e = model.weights[features[:, at]].sum(axis=0) + model.bias
        x.append(document_features(marginals(e.astype(np.float64), own, trans), own))
    model.logistic = fit_logistic(np.concatenate(x), y[rest])
    return model


def score_texts(model: CrfModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Score of each text, and the starts and ends, in bytes, of its toxic runs."""
    a, z, first, features = token_features(data, off, model.bits)
    p = marginals((model.weights[features].sum(axis=0) + model.bias).astype(np.float64), first, model.transitions)
    score = 1 / (1 + np.exp(-np.clip(document_features(p, first) @ model.logistic, -30, 30)))
    hot = np.flatnonzero(p >= 0.5)
    doc = np.searchsorted(first, hot, "right") - 1
    new = np.append(True, (hot[1:] != hot[:-1] + 1) | (doc[1:] != doc[:-1])) if len(hot) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(hot)) - 1 if len(head) else head
    begin, end, of = a[hot[head]] - off[doc[head]], z[hot[last]] - off[doc[head]], doc[head]
    cut = np.searchsorted(of, np.arange(len(off)))
    return score, [begin[cut[i] : cut[i + 1]].tolist() for i in range(len(off) - 1)], [end[cut[i] : cut[i + 1]].tolist() for i in range(len(off) - 1)]


def held_out(id_col, fold: int):
    """True for the ids whose labels the model never sees."""
    return F.coalesce(F.crc32(id_col.cast("string")) % fold == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", *, settings: ToxicitySettings | None = None) -> CrfModel:
    """A model from a bounded sample of the labelled documents that aren't held out. Rows without a label or an id take
    no part; labels without a document neither. An id with several labels, or several texts, counts once: as toxic if any
    says so, by its least text."""
    s = settings or ToxicitySettings()
    own = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(toxic_col).cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)")
    own = own.where(~held_out(F.col("_id"), s.fold))
    order = F.xxhash64(F.col("_id"), F.lit(1)), F.col("_id")
    own = own.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    some = own.where("_toxic = 1").orderBy(*order).limit(s.toxic_sample).unionByName(own.where("_toxic = 0").orderBy(*order).limit(s.clean_sample))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.octet_length("_text") <= s.text_bytes)
    # ids of a bounded sample, and one text of each: the least, where an id stands in several rows
    one = texts.join(F.broadcast(some), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    one = written(one, "sample")
    sizes = one.select("_id", F.octet_length("_text").alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()
    total = np.cumsum([r["n"] for r in sizes])
    chosen = [r["_id"] for r, n in zip(sizes, total.tolist(), strict=True) if n <= s.sample_bytes]
    rows = one.where(F.col("_id").isin(chosen)).orderBy(F.xxhash64("_id"), "_id").collect() if len(chosen) < len(sizes) else one.orderBy(F.xxhash64("_id"), "_id").collect()
    model = train([r["_text"] for r in rows], [r["_toxic"] for r in rows], s)
    del rows
    give_back()
    return model


def tag_toxicity(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` and toxic_score (0 to 1), toxic_starts and toxic_ends (byte offsets of the toxic runs).

    A null or empty text, or one without letters, has the score of a document without toxic tokens. Names of columns
    that are already there are replaced. An empty table gives none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = docs.drop("toxic_score", "toxic_starts", "toxic_ends")
    names = base.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def run(batches):
        m = shared.value
        for b in batches:
            data, off = bytes_of(b[text_col])
            for i, j in chunks(off):
                score, starts, ends = score_texts(m, data[off[i] : off[j]], off[i : j + 1] - off[i])
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(own[c] for c in names), pa.array(score), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=[*names, "toxic_score", "toxic_starts", "toxic_ends"])
        give_back()

    return base.mapInArrow(run, f"{kinds}, toxic_score double, toxic_starts array<long>, toxic_ends array<long>")


def toxicity(docs: DataFrame, labels: DataFrame, *, settings: ToxicitySettings | None = None) -> DataFrame:
    """Fits and applies the model: doc_id, held_out, score, predicted (1 from 0.5), toxic_starts, toxic_ends. See
    `fit_toxicity` and `tag_toxicity` for nulls and empty texts and tables. A row without an id is not held out."""
    s = settings or ToxicitySettings()
    model = fit_toxicity(docs, labels, settings=s)
    out = tag_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id"), s.fold).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_starts", "toxic_ends")
