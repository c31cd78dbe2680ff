"""Vector deduplication and search against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.llm.embedding_dedup import PivotSettings, embedding_dedup
from glyphgrid.llm.exact_topk import TopKSettings, exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, shard int, pivot int"


def odd_vectors(spark, n=150, dim=16, seed=0, shared_ids=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i % 3 == 1:  # near the one before
            v = np.array(rows[-1][1]) + rng.normal(size=dim) * 0.02
        if i % 10 == 7:
            v = np.array(rows[-1][1])
        rows.append((i * 2, [float(np.float32(x)) for x in v], int(i // 30)))
    if shared_ids:  # ids that stand in several rows, alike or not
        rows += [rows[4]] * 3 + [(4, rows[20][1], 0), (4, rows[40][1], 1), (8, rows[100][1], rows[100][2])]
    rows += [rows[4], (1001, None, 1), (1003, [0.0] * dim, 1), (1005, [1.0, None] * (dim // 2), 1), (1007, [float("nan")] * dim, 1), (1009, [float("inf")] * dim, 1), (1011, rows[0][1], None), (None, rows[0][1], 0), (1013, [1.0, 2.0], 1), (1015, [], 1), (1000, [3e38] * dim, 2)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3), rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows, least):
    n = len(rows)
    ok = [i is not None and lab is not None and usable(v) and any(v) for i, v, lab in rows]
    unit = [np.array(v, float) / np.abs(v).max() if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    unit = [u / np.sqrt((u * u).sum()) if u is not None else None for u in unit]
    links, parent = [0] * n, {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    ends = [None if i is None else find(i) if k else i for (i, _, _), k in zip(rows, ok, strict=True)]
    return [(i, k, e, e is None or e == i) for (i, _, _), k, e in zip(rows, links, ends, strict=True)]


@pytest.mark.parametrize("settings", [PivotSettings(), PivotSettings(square=8, least_pivots=32), PivotSettings(density=0.1, least_pivots=5)])
def test_embedding_dedup_matches_brute_force(spark, settings):
    df, rows = odd_vectors(spark, shared_ids=True)
    got = [tuple(r) for r in embedding_dedup(df, settings=settings).collect()]
    assert Counter(got) == Counter(brute_links(rows, settings.cosine))


def test_pivot_index_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        u = rng.normal(size=64)
        u /= np.linalg.norm(u)
        w = rng.normal(size=64)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = 0.932
        rows += [(2 * i, u.tolist(), 0), (2 * i + 1, (c * u + np.sqrt(1 - c * c) * w).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sum(r["n_links"] for r in embedding_dedup(df).collect()) / 2
    assert found >= 0.97 * 400


def brute_topk(rows, asked, k, scale=256):
    q = {}
    for i, v, _ in rows:
        if i is not None and usable(v):
            q.setdefault(i, []).append([int(np.floor(scale * x)) for x in v])
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for i, vs in q.items():
        if asked(i):
            s = sorted((-cut(sum(a * b for a, b in zip(vs[0], w, strict=True))), j) for j, ws in q.items() if j != i for w in ws if len(w) == len(vs[0]))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("settings", [TopKSettings(), TopKSettings(k=3, bins=4, block=20), TopKSettings(k=500, block=64)])
def test_topk_is_exact(spark, settings):
    df, rows = odd_vectors(spark, n=80, seed=1)
    got = [tuple(r) for r in exact_topk(df, F.col("vec_id") % 10 == 0, settings=settings).collect()]
    assert Counter(got) == Counter(brute_topk(rows, lambda i: i % 10 == 0, settings.k))


def test_topk_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<float>")
    got = exact_topk(df, F.col("vec_id") == 50, settings=TopKSettings(block=16)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def test_topk_of_a_query_id_in_two_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_topk(df, F.col("vec_id") == 0, settings=TopKSettings(k=3)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3 << 16), (0, 2, 2, 2 << 16), (0, 3, 1, 0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup(empty).count() == 0
    assert exact_topk(empty, F.col("vec_id") % 50 == 0).count() == 0
