"""The Katz model against a model counted and evaluated in plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphgrid.llm.katz import MOST, KatzModel, KatzSettings, backoff_weight, katz_scores, unigram_mass
from glyphgrid.llm.tree_queries import QUERIES

from .helpers import odd_documents, words


def lowered(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode()) for w in words(text)] + [None]


class Plain:
    def __init__(self, texts, order):
        self.order, self.counts, self.after = order, [None, *(Counter() for _ in range(order))], defaultdict(set)
        for t in texts:
            for k in range(1, order + 1):
                for i in range(k, len(t) + 1):
                    self.counts[k][tuple(t[i - k : i])] += 1
                    self.after[tuple(t[i - k : i - 1])].add(t[i - 1])
        self.total, self.types = sum(self.counts[1].values()), len(self.counts[1])
        self.kept = [None, *map(self._kept, range(1, order + 1))]
        self.sums = {}

    def _kept(self, k):
        n = Counter(self.counts[k].values())
        rest = 6 * n[6] / n[1] if n[1] else 1
        out = {}
        for r in range(1, 6):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 1
            out[r] = x if 0 < x < 1 else 1
        return out

    def _context(self, h):
        if h not in self.sums:
            k = len(h) + 1
            counts = [self.counts[k][(*h, w)] for w in self.after[h]]
            lost = sum(c * (1 - self.kept[k].get(c, 1)) for c in counts)
            whole = (self.counts[k - 1][h] if h else self.total) + (lost == 0)
            others = 1 - sum(self(w, h[1:]) for w in self.after[h]) if h else 1
            self.sums[h] = whole, (lost or 1) / whole / others
        return self.sums[h]

    def __call__(self, w, h):
        k = len(h) + 1
        if h and not self.counts[k - 1][h]:
            return self(w, h[1:])
        whole, weight = self._context(h)
        c = self.counts[k][(*h, w)]
        return c * self.kept[k].get(c, 1) / whole if c else weight * (self(w, h[1:]) if h else 1)

    def row(self, t):
        base = sum(math.log10((self.counts[1][(w,)] + 0.5) / (self.total + 0.5 * (self.types + 1))) for w in t)
        score = sum(math.log10(self(w, tuple(t[max(0, i - self.order + 1) : i]))) for i, w in enumerate(t))
        return len(t), sum((w,) in self.counts[1] for w in t), self.total, base, score


def agrees(got, rows, trained, order):
    model = Plain([lowered(t) for i, t in rows if trained(i)], order)
    want = sorted(((i, trained(i), *model.row(lowered(t))) for i, t in rows), key=str)
    got = sorted(((r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    key = lambda r: (str(r[0]), r[1:5], round(r[5], 4))  # noqa: E731 - rows of one id in any order
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def third(i):
    return i is None or i % 3 != 0


@pytest.mark.parametrize(("order", "size"), [(1, 900), (2, 900), (3, 4000), (2, 1 << 20)])
def test_scores_of_odd_texts(spark, order, size):
    df, rows = odd_documents(spark)
    got = katz_scores(df, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)), settings=KatzSettings(order, size)).collect()
    agrees(got, rows, third, order)


def test_a_common_context_is_spread(spark):
    text = " ".join(f"the w{i * i % 977}" for i in range(9000))
    rows = [(1, text), (2, text[::-1]), (3, "the w1 the unheard the w4"), (4, text[:40_000]), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = KatzModel(df, F.col("doc_id") != 3, settings=KatzSettings(2, 20_000))
    assert len(model.levels[1].spread) == 2  # "the" and what it reads backwards
    got = model.scores().withColumn("train_tokens", F.lit(model.levels[0].tokens)).collect()
    agrees(got, rows, lambda i: i != 3, 2)


def test_stored_tables_hold_a_normalised_model(spark):
    df, rows = odd_documents(spark, n=40)
    model = KatzModel(df, F.lit(True), settings=KatzSettings(3, 3000))
    plain = Plain([lowered(t) for _, t in rows], 3)
    grams = {k: {(r["context"], r["word"]): (r["number"], r["count"]) for r in model.ngrams(k).collect()} for k in (1, 2, 3)}
    assert {k: sorted(c for _, c in g.values()) for k, g in grams.items()} == {k: sorted(plain.counts[k].values()) for k in grams}
    # all that follows a context, and what it leaves to the rest, is 1: from the tables alone
    first = model.levels[0]
    whole, unknown = unigram_mass(first)
    kept = [x.kept() for x in model.levels]
    p = {number: c * (kept[0][c] if c <= MOST else 1) / whole for number, c in grams[1].values()}
    assert sum(p.values()) + unknown == pytest.approx(1, abs=1e-12)
    count = dict(grams[1].values())
    weights = {}
    for r in model.contexts(2).collect():
        x = weights.setdefault(r["context"], [[0] * MOST, 0.0])
        x[0] = [a + r[f"n{i + 1}"] for i, a in enumerate(x[0])]
        x[1] += r["low"]
    import numpy as np

    after = defaultdict(list)
    for (context, word), (_, c) in grams[2].items():
        after[context].append((word, c))
    for context, (left, low) in weights.items():
        loses = any(n and kept[1][r] < 1 for r, n in enumerate(left, 1))
        weight, divisor = backoff_weight(np.array([count[context]]), np.array([loses]), np.array([left]), np.array([low]), kept[1])
        seen = sum(c * (kept[1][c] if c <= MOST else 1) / divisor[0] for _, c in after[context])
        rest = 1 - sum(p[w] for w, _ in after[context])
        assert seen + weight[0] * rest == pytest.approx(1, abs=1e-9)


def test_no_texts_and_no_training(spark):
    schema = "doc_id long, text string"
    assert katz_scores(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    got = katz_scores(spark.createDataFrame([(1, "some words"), (None, None)], schema), F.lit(None).cast("boolean")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_registered_query_and_held_out_gain(spark, sf_dir):
    got = QUERIES["op12_katz_scoring"](spark, sf_dir)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    renamed = [r.asDict() | {"trained": not r["held_out"]} for r in got.collect()]
    model = Plain([lowered(t) for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1], 2)
    want = {i: model.row(lowered(t)) for i, t in docs}
    for r in renamed:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert (r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]][3:], abs=1e-6)
        assert r["trained"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1)
    held = [r for r in renamed if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
