"""Suffix-array, window and MinHash deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphgrid.llm import _sais
from glyphgrid.llm._components import components
from glyphgrid.llm.minhash_dedup import MinHashSettings, minhash_dedup
from glyphgrid.llm.suffix_dedup import SuffixSettings, suffix_dedup
from glyphgrid.llm.window_dedup import WindowSettings, window_dedup

from .helpers import odd_documents, spark_hash, words


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 200])
        texts = [bytes(rng.randrange(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        raw = np.frombuffer(b"".join(x + b"\xff" for x in texts), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        t = np.zeros(len(raw) + 1, np.uint16)
        t[:-1] = raw.astype(int) + 2
        t[ends] = 1
        plain = t.tolist()
        assert _sais.suffix_array(t, 258).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        owner = np.array([rng.randrange(4) for _ in texts])
        want = [min(p for y, p in zip(texts, owner, strict=True) if x[i : i + 5] in y) if i + 5 <= len(x) else o for x, o in zip(texts, owner, strict=True) for i in range(len(x) + 1)]
        assert _sais.repeated_first(raw, ends, owner, 5).tolist() == want


def brute_suffix(rows, width):
    last = 1 << 62
    first = {}
    coded = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(coded):
        for k in range(len(b) - width + 1):
            first.setdefault(b[k : k + width], i)
    out = []
    for (i, _), (key, b) in zip(rows, coded, strict=True):
        m = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < key:
                m[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [SuffixSettings(), SuffixSettings(hot=2, route=16, chunk=200, blocks=1)])
def test_suffix_dedup_is_exact(spark, settings):
    df, rows = odd_documents(spark)
    got = [tuple(r)[:5] for r in suffix_dedup(df, settings=settings).collect()]
    assert Counter(got) == Counter(brute_suffix(rows, settings.width))


def test_suffix_dedup_text_keeps_whole_letters_and_columns(spark):
    text = "é" * 60
    df = spark.createDataFrame([(1, "x" + text, "fr"), (2, "y" + text + "z", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in suffix_dedup(df, text=True, carry=("lang",)).collect()}
    assert got[1]["kept_text"] == "x" + text and got[1]["c_lang"] == "fr"
    assert got[2]["kept_text"] == "yz" and got[2]["c_lang"] is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for f in (suffix_dedup, window_dedup, minhash_dedup):
        assert f(empty).count() == 0


def brute_windows(rows, n):
    order = sorted((((1 << 62) + (spark_hash(t) >> 2) if i is None else i, t or "", k) for k, (i, t) in enumerate(rows)))
    seen, out = set(), {}
    for _, t, k in order:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            if g in seen:
                gone[j : j + n] = [True] * n
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out[k] = (rows[k][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return list(out.values())


@pytest.mark.parametrize("settings", [WindowSettings(), WindowSettings(depth=1, width_bits=4), WindowSettings(window=3), WindowSettings(depth=3, width_bits=12)])
def test_window_dedup_is_exact(spark, settings):
    df, rows = odd_documents(spark, seed=3)
    got = [tuple(r) for r in window_dedup(df, settings=settings).collect()]
    assert Counter(got) == Counter(brute_windows(rows, settings.window))


def brute_near(rows, width, percent):
    sets = defaultdict(set)
    sizes = []
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sizes.append(len(s))
        if i is not None and s:
            sets[i].add(frozenset(s))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    root = {i: find(i) for i in sets}
    return [(i, n, None if i is None else root.get(i, i), i is None or root.get(i, i) == i) for (i, _), n in zip(rows, sizes, strict=True)]


@pytest.mark.parametrize("settings", [MinHashSettings(), MinHashSettings(square=3, collections=18)])
def test_minhash_dedup_matches_brute_force(spark, settings):
    df, rows = odd_documents(spark, seed=5)
    got = [tuple(r) for r in minhash_dedup(df, settings=settings).collect()]
    assert Counter(got) == Counter(brute_near(rows, settings.shingle, settings.percent))


def test_minhash_finds_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash_dedup(df, settings=MinHashSettings(square=32)).collect()]
    assert Counter(got) == Counter(brute_near(rows, 5, 85))


def test_a_chain_of_candidates_is_compared_by_buckets(spark):
    from glyphgrid.llm.minhash_dedup import _groups

    n = 5000
    near = spark.createDataFrame([(i, 0) for i in range(1, n)], "id long, component long")
    chain = [(k * 10 + j, k + j) for k in range(n - 1) for j in (0, 1)]
    buckets = spark.createDataFrame([(b - b % 10, i) for b, i in chain], "bucket long, id long")
    sizes = Counter(r["count"] for r in _groups(near, buckets, 192).groupBy("cluster").count().collect())
    assert sizes == {2: n - 1}
    # one bucket of all is compared at once, and so is a small component
    one = spark.createDataFrame([(k, i) for k in range(3) for i in range(n)], "bucket long, id long")
    assert [r["count"] for r in _groups(near, one, 192).groupBy("cluster").count().collect()] == [n]
    few = spark.createDataFrame([(i, 0) for i in range(1, 100)], "id long, component long")
    assert [r["count"] for r in _groups(few, buckets, 192).groupBy("cluster").count().collect()] == [100]


def test_minhash_links_the_same_whether_by_components_or_buckets(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):  # neighbours share six tenths of their shingles, every third has a near copy
        w = [f"w{c * 40 + k}" for k in range(100)]
        rows.append((2 * c, " ".join(w)))
        if c % 3 == 0:
            w[rng.randrange(100)] = "x"
            rows.append((2 * c + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for side in (2, 192):
        got = [tuple(r) for r in minhash_dedup(df, settings=MinHashSettings(square=side)).collect()]
        assert Counter(got) == Counter(brute_near(rows, 5, 85))


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(0)
    path = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5, i) for i in range(2000, 2300)]
    edges = path + star + [(7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {i: 1000 for i in range(1001, 1401)} | {i: 5 for i in range(2000, 2300)}
    for limit in (1 << 20, 8):
        assert {r["id"]: r["component"] for r in components(df, one_task=limit).collect()} == want
    assert components(df.limit(0)).count() == 0
