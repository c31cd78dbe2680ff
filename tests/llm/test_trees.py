"""The Merkle manifest and the conversation trie against brute force, on odd tables too."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from glyphgrid.llm.conversation_trie import rebuilt_trie
from glyphgrid.llm.merkle import merkle_manifest, proof_digests
from glyphgrid.llm.tree_queries import QUERIES

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(value):
    return zlib.crc32(str(value).encode())


def climbed(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, i, fanout):
    for nodes in levels[:-1]:
        first = i - i % fanout
        yield nodes[first:i], nodes[i + 1 : first + fanout]
        i //= fanout


def expected_manifest(rows, fanout=2):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = climbed([leaf(r) for r in own], fanout)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = climbed([trees[x][-1][0] for x in order], fanout)
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(groups[lang]):
            path = [*way(trees[lang], i, fanout), *way(top, k, fanout)]
            other = r[3] + 1 if r[0] is not None and r[3] is not None and crc(r[0]) % 7 == 0 else r[3]
            h = leaf((*r[:3], other, r[4]))
            for left, right in path:
                h = sha("".join([*left, h, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df, **given):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted(map(tuple, proof_digests(merkle_manifest(df, altered={"n_chars": tampered}, **given)).collect()), key=str)


ODD = [
    (None, "a", "en", 3, "abc"), (None, "a", "en", 3, "abc"), (7, None, None, None, None), (7, None, None, None, None), (7, "b", "en", 1, "x"),
    (7, "b", "en", 1, "y"), (-4, "a", "de", 0, ""), (2**62, "ä", "日本", 5, "é" * 40_000), (11, "", "", 2, "\x00-:"),
    *((i, "s", "en", i, "t" * (i % 5)) for i in range(20, 61)),
]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 4), (3, 2)])
def test_manifest_of_odd_rows(spark, fanout, levels):
    df = spark.createDataFrame(ODD, DOCS).withColumn("key", F.lit("k")).withColumn("hash", F.lit("h")).withColumn("index", F.lit(0))
    got = manifest_rows(df.repartition(5), fanout=fanout, levels=levels)
    assert got == expected_manifest(list(ODD), fanout)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 17])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", 1, "t") for i in range(n)]
    assert manifest_rows(spark.createDataFrame(rows, DOCS)) == expected_manifest(rows)


def expected_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    built = {c: (*own.get(c - int(math.fmod(c, 100)), [])[: crc(c) % 6], *own[c][crc(c) % 6 :]) for c in own}
    members, below = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        under = below.get(p, [])
        leaves, saved = sum(sums[q][0] for q in under) or 1, sum(sums[q][1] for q in under) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        sums[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(under), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted(map(tuple, rebuilt_trie(df).collect()), key=str)


def test_trie_of_odd_conversations(spark):
    turns = [(c, t, "user" if t % 2 else None, f"t{min(t, c % 3)}") for c in [*range(100, 140), 200, 305, -3, -250] for t in range(c % 9)]
    turns += [(0, None, None, None), (0, None, "user", ""), (0, 1, "user", "é" * 30_000), (0, 1, "user", "twice"), (0, 1, "user", "twice"), (None, 1, "user", "x")]
    turns += [(7, t, "user", "same") for t in range(300)] + [(8, t, "user", "same") for t in range(299)]
    df = spark.createDataFrame(turns, TURNS).withColumn("depth", F.lit(9)).withColumn("digest", F.lit("d")).withColumn("_tie", F.lit(0))
    got = trie_rows(df.repartition(5))
    assert got == expected_trie(turns)
    assert max(r[1] for r in got) > 250


def test_trie_whose_chains_hang_below_each_other(spark):
    # every conversation leaves the one before it a turn later
    turns = [(100 * c, t, "user", "same" if t <= c else f"own {c}") for c in range(1, 40) for t in range(c + 3)]
    got = trie_rows(spark.createDataFrame(turns, TURNS))
    assert got == expected_trie(turns)


def test_trie_of_equal_and_of_no_conversations(spark):
    turns = [(c, t, "user", f"t{t}") for c in range(1000, 1200) for t in range(7)]
    assert trie_rows(spark.createDataFrame(turns, TURNS)) == expected_trie(turns)
    assert trie_rows(spark.createDataFrame([], TURNS)) == []


@pytest.mark.parametrize(("name", "table"), [("op11_merkle_manifest", "documents"), ("op13_conversation_trie", "conversations")])
def test_registered_queries(spark, sf_dir, name, table):
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    got = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()), key=str)
    if table == "documents":
        assert got == expected_manifest([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    else:
        assert got == expected_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
