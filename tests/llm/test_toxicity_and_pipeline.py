"""The random field against brute force, held-out accuracy, and the whole pipeline."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.llm import registry
from glyphgrid.llm import toxicity as T
from glyphgrid.llm._text import Hasher
from glyphgrid.plans.catalog import QUERIES as OTHER

from .helpers import odd_documents


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 3, 5, 155, 156])
    e, trans = rng.normal(size=156), rng.normal(size=(2, 2))
    p, pairs = T.marginals(e, first, trans, pairs=True)
    want, expected = [], np.zeros((2, 2))
    for a, z in zip(first[:-1], first[1:], strict=True):
        n = z - a
        if not n:
            continue
        pot = np.stack([np.zeros(n), e[a:z]], axis=1)
        fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
        fw[0] = pot[0]
        for t in range(1, n):
            fw[t] = pot[t] + np.logaddexp(fw[t - 1][0] + trans[0], fw[t - 1][1] + trans[1])
        for t in range(n - 2, -1, -1):
            bw[t] = np.logaddexp(trans[:, 0] + pot[t + 1][0] + bw[t + 1][0], trans[:, 1] + pot[t + 1][1] + bw[t + 1][1])
        g = fw + bw
        want += list(np.exp(g[:, 1] - np.logaddexp(g[:, 0], g[:, 1])))
        for t in range(1, n):
            x = fw[t - 1][:, None] + trans + pot[t][None] + bw[t][None]
            x = np.exp(x - x.max())
            expected += x / x.sum()
    assert np.allclose(p, want) and np.allclose(pairs, expected)


def corpus(n=600):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{k}" for k in rng.integers(0, 80, 60)]
        bad = i % 6 == 0
        if bad:
            for k in rng.integers(0, 60, 4):
                w[k] = ["Nasty", "vile!", "awful"][rng.integers(0, 3)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in T.toxicity(docs, marks).collect()}
    held = [(out[i]["predicted"], y) for i, y in labels if out[i]["held_out"]]
    assert len(held) > 60 and np.mean([a == b for a, b in held]) > 0.97
    r = out[0]
    text = dict(rows)[0].encode()
    assert {text[a:z].decode().lower() for a, z in zip(r["toxic_starts"], r["toxic_ends"], strict=True)} <= {"nasty", "vile", "awful"} and r["toxic_starts"]


def test_scores_do_not_depend_on_other_columns(spark):
    rows, labels = corpus(200)
    model = T.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    df, odd = odd_documents(spark)
    out = T.tag_toxicity(df, model)
    assert out.columns[: len(df.columns)] == df.columns
    got = defaultdict(set)
    for r in out.collect():
        assert 0 <= r["toxic_score"] <= 1
        got[r["text"]].add(r["toxic_score"])
    assert all(len(v) == 1 for v in got.values()) and got[None] == got[""]
    assert T.tag_toxicity(df.limit(0), model).count() == 0


def brute_score(model, text):
    """Score and toxic runs of one text: token by token, with sums over tags in logarithms."""
    raw = (text or "").encode()
    tokens = [(m.start(), m.end()) for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw)]
    down = 64 - model.bits

    def number(b, factor):
        h = int(Hasher(np.frombuffer(b, np.uint8))(np.array([0]), np.array([len(b)]))[0])
        return (h * factor % 2**64) >> down

    e = []
    for a, z in tokens:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in raw[a:z])
        e.append(sum(float(model.weights[k]) for k in (number(w, 1), number(w[:6], 0x9E3779B97F4A7C15), number(w[-5:], 0xC2B2AE3D27D4EB4F))) + model.bias)
    n, t = len(e), model.transitions
    pot = [(0.0, x) for x in e]
    fw, bw = [pot[0]] if n else [], [(0.0, 0.0)] * n
    for k in range(1, n):
        fw.append(tuple(pot[k][j] + np.logaddexp(fw[-1][0] + t[0, j], fw[-1][1] + t[1, j]) for j in (0, 1)))
    for k in range(n - 2, -1, -1):
        bw[k] = tuple(np.logaddexp(t[i, 0] + pot[k + 1][0] + bw[k + 1][0], t[i, 1] + pot[k + 1][1] + bw[k + 1][1]) for i in (0, 1))
    p = [1 / (1 + np.exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(fw, bw, strict=True)]
    total = sum(v for v in p if v >= 0.1)
    x = [1, total / (1 + total), np.log1p(1000 * total / n), max(p)] if n else [1, 0, 0, 0]
    runs = []
    for k, (a, z) in enumerate(tokens):
        if p[k] >= 0.5:
            if k and p[k - 1] >= 0.5:
                runs[-1][1] = z
            else:
                runs.append([a, z])
    return 1 / (1 + np.exp(-np.dot(x, model.logistic))), [r[0] for r in runs], [r[1] for r in runs]


def test_scores_and_spans_equal_brute_force(spark):
    rows, labels = corpus(300)
    model = T.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    _, odd = odd_documents(spark)
    some = [t for _, t in odd] + [t for _, t in rows[:40]] + ["Nasty vile AWFUL, nasty-vile " * 40, "vilé ñasty"]
    out = T.tag_toxicity(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3), model)
    toxic = 0
    for r in out.collect():
        score, starts, ends = brute_score(model, r["text"])
        assert abs(score - r["toxic_score"]) < 1e-6 and (starts, ends) == (r["toxic_starts"], r["toxic_ends"])
        toxic += len(starts)
    assert toxic > 20


def test_training_takes_one_text_of_an_id_within_its_bounds(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(T, "train", lambda texts, toxic, s: seen.update(n=len(texts), b=sum(len(t.encode()) for t in texts if t)))
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(5000)] + [(i, "x" * 1000) for i in range(100, 200)] + [(300, "y" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (300, 0)] + [(i, i % 2) for i in range(100, 200)], "doc_id long, toxic int")
    T.fit_toxicity(docs, labels, settings=T.ToxicitySettings(toxic_sample=30, clean_sample=30, sample_bytes=20_000))
    assert 0 < seen["n"] <= 20 and seen["b"] <= 20_000


def test_models_of_one_kind_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)]):
        out = T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(out) == 2 and all(0 <= r["score"] <= 1 for r in out)


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash near-dedup", "suffix-array dedup", "source mixing", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        if k < 4:
            assert sorted(out.columns) == sorted(columns) and 0 < out.count() <= before
            docs = out
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.select("doc_id", "text").collect()}
    packed = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.countDistinct("shard", "bin", "bin_offset").alias("k"))
    assert all(r["n"] % max(1, total[r["doc_id"]]) == 0 for r in packed.collect())


def test_pipeline_on_odd_documents(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, _ = odd_documents(spark)
    docs = docs.select(*corpus_pipeline.COLUMNS)
    for frame in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, frame = frame, stage(spark, frame, sf_dir)
            if k == 4:
                break
            a, b = (Counter(r["doc_id"] for r in x.select("doc_id").collect()) for x in (before, frame))
            if k == 0:
                assert set(b) <= set(a) and all(b[i] == a[i] for i in b)  # rows of one text share a score; ids here aren't toxic
            if k == 1:  # rows of one id whose texts differ stay apart; which rows stay is tested below
                assert all(n <= a[i] for i, n in b.items()) and bool(a) == bool(b)
            if k == 2:
                assert a == b
            if k == 3:  # whole passes and the beginning of one more
                assert set(b) <= set(a) and all(n <= 5 * a[i] for i, n in b.items())
        frame.collect()


def test_pipeline_links_near_copies_from_eight_tenths(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for k, (n, changed) in enumerate(((91, 9), (89, 11))):  # of n shingles each, `changed` differ: similarity 0.82 and 0.78
        w = [f"w{k}x{i}" for i in range(n + 4)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-changed] + [f"n{k}x{i}" for i in range(changed)]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()) == [0, 2, 3]


def test_all_operators_are_registered_once():
    names = sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert not set(names) & set(OTHER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    from ..oracle import compare

    compare(duckdb, registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


def _near(rows, percent=80):
    """Groups of rows by brute force: rows of word shingles of a similarity of `percent` hundredths or more."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_near_dedup_stage_keeps_one_row_of_each_group(spark, sf_dir):
    import corpus_pipeline

    df, _ = odd_documents(spark)
    extra = [(500, "one text of an id that two rows share here"), (500, "quite another text that stands under the very same number"), (None, "a copy without any number at all"), (None, "a copy without any number at all"), (None, None), (None, "")]
    docs = df.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long")).repartition(4)
    rows = [tuple(r) for r in docs.collect()]
    found = defaultdict(list)
    for row, g in zip(rows, _near(rows), strict=True):
        found[g].append(row)
    got = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()]
    assert len(got) == len(found)
    kept = Counter(got)
    for members in found.values():
        ids = [r[0] for r in members if r[0] is not None]
        least = min(ids) if ids else None
        assert any(kept[r] for r in members if r[0] == least), members
    assert {t for i, t, *_ in got if i == 500} == {t for i, t in extra if i == 500}
    assert sum(i is None and t == extra[2][1] for i, t, *_ in got) == 1
