"""Token files, rollups, packing and mixing: exact round trips and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphgrid.llm import huffman_tokens as H
from glyphgrid.llm._counts import word_count
from glyphgrid.llm._session import work_path, written
from glyphgrid.llm._text import bytes_of
from glyphgrid.llm._words import WordTokenizer
from glyphgrid.llm.mixing import MixSettings, mixed_documents, temperature_mix
from glyphgrid.llm.packing import PackingSettings, best_fit_pack, pack_lengths, pack_tokens, places
from glyphgrid.llm.rollups import TokenRollup, delete_deltas, insert_deltas, revise_deltas, tokenizer_counts

from .helpers import odd_documents, words

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def odd_texts(n=3000):
    rng = random.Random(0)
    letters = list("abcXYZ  \n\t.,'’“”!?-0123456789éÉßñŒœİıǅΣσςαЖж漢字🙂́̈  \u0085\x00×÷ªº¹½ŉſﬁ") + ["'s", "'re", "'LL", " the", "<|endoftext|>", "über"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_word_tokenizer_equals_the_library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = odd_texts()
    ids, n = WordTokenizer.at(path).encode(*bytes_of(pa.array(texts)), 2)
    cut = np.append(0, np.cumsum(n))
    for k, text in enumerate(texts):
        assert ids[cut[k] : cut[k + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids + [2]


def test_word_tokenizer_forgets_within_its_capacity():
    w = WordTokenizer(WORD_BPE, capacity=50)
    data, off = bytes_of(pa.array(["some words here", "and other words", "x " * 30]))
    first = w.encode(data, off, 2)[0].tolist()
    for _ in range(5):
        w.encode(*bytes_of(pa.array([f"n{random.random()} z" for _ in range(20)])), 2)
    assert len(w.place) <= 80 and w.encode(data, off, 2)[0].tolist() == first


@pytest.mark.parametrize("n, limit", [(1, 16), (2, 16), (5, 3), (300, 9), (20000, 16), (1000, 12)])
def test_huffman_code_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.3, n).clip(0, 10**9)
    counts[rng.random(n) < 0.2] = 0
    counts[0] = 1
    lengths = H.code_lengths(counts, limit)
    used = lengths[counts > 0]
    assert (lengths[counts == 0] == 0).all() and (used > 0).all() and used.max() <= limit
    if len(used) > 1:
        assert abs(sum(2.0 ** -int(x) for x in used) - 1) < 1e-9
    ids = rng.choice(np.flatnonzero(counts), 3001).astype(np.uint32)
    bits, marks = H.pack(ids, H.canonical(lengths), lengths, 256)
    count = np.full(len(marks), 256)
    count[-1] = 3001 - 256 * (len(marks) - 1)
    d = H.Decoder(lengths)
    assert (d.unpack(bits, marks, count, 256) == ids).all()
    assert (d.unpack(bits, marks[3:4], count[3:4], 256) == ids[768:1024]).all()  # from any checkpoint


def test_package_merge_is_optimal():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    heap = [(int(c), [i]) for i, c in enumerate(counts)]
    cost = 0
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, (a + b, x + y))
    assert int((H.code_lengths(counts, 16) * counts).sum()) == cost
    assert int((H.code_lengths(counts, 4) * counts).sum()) >= cost


def test_token_file_round_trip(spark):
    from tokenizers import Tokenizer

    df, rows = odd_documents(spark)
    t = Tokenizer.from_file(WORD_BPE)
    want, start = [], 0
    coded = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]
    for i, ids in sorted(coded, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in H.token_digests(df, WORD_BPE, settings=H.HuffmanSettings(block=300, step=16)).collect()]
    assert Counter(got) == Counter(want)
    assert H.token_digests(df.limit(0), WORD_BPE).count() == 0


def test_packing_holds_every_token_once(spark):
    df, rows = odd_documents(spark)
    s = PackingSettings(sizes=(32, 64, 128))
    out = best_fit_pack(df, settings=s).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(i for i, _ in rows)
    total = Counter()
    for r in out:
        total[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, t in rows:
        want[i] += len(words(t))
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in want.items() if v}
    bins = defaultdict(list)
    for r in out:
        bins[r["shard"], r["bin"]].append(r)
    for have in bins.values():
        size = {r["bin_size"] for r in have}
        spans = sorted((r["bin_offset"], r["n_tokens"]) for r in have if r["n_tokens"])
        used = sum(n for _, n in spans)
        assert len(size) == 1 and min(x for x in s.sizes if x >= used) == size.pop()  # cut down to the contents
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert best_fit_pack(df.limit(0)).count() == 0


def brute_pack(lengths, s):
    """Bin and offset of each length: longest first, into the open bin with the least room that takes it, or a new one of the
    size that costs least for each token, every size tried."""
    todo = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    ahead = sorted(n for n in lengths if n)
    room, used, where = [], [], {}
    for k in todo:
        n = lengths[k]
        if not n:
            if not room:
                room.append(min(s.sizes)), used.append(0)
            where[k] = (0, 0)
            continue
        ahead.remove(n)
        fits = [(room[b], b) for b in range(len(room)) if room[b] >= n]
        if fits:
            b = min(fits)[1]
        else:
            costs = []
            for size in sorted(s.sizes):
                if size >= n:
                    small = [x for x in ahead if x <= size - n]
                    fill = min(size - n, sum(small))
                    if small and fill == size - n and min(ahead) > 1:
                        fill = max(0, fill - min(ahead) // 2)
                    final = min(x for x in s.sizes if x >= n + fill)
                    costs.append(((final + s.bin_cost) / (n + fill), size))
            b = len(room)
            room.append(min(costs)[1]), used.append(0)
        where[k] = (b, used[b])
        used[b] += n
        room[b] -= n
    return [where[k][0] for k in range(len(lengths))], [where[k][1] for k in range(len(lengths))], [min(x for x in s.sizes if x >= u) for u in used]


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    s = PackingSettings(sizes=((32, 64, 128), (10,), (7, 100), (512, 1024, 2048, 4096))[seed % 4], bin_cost=(0, 3, 16)[seed % 3])
    lengths = np.minimum(rng.geometric((0.03, 0.3, 0.05, 0.005)[seed % 4], 300), max(s.sizes))
    lengths[rng.random(300) < 0.05] = 0
    bins, offsets, sizes = pack_lengths(lengths, s)
    assert (bins.tolist(), offsets.tolist(), sizes) == brute_pack(lengths.tolist(), s)


@pytest.mark.parametrize("shards", [1, 3])
def test_packed_bins_hold_the_tokens(spark, shards):
    from tokenizers import Tokenizer

    df, rows = odd_documents(spark)
    t = Tokenizer.from_file(WORD_BPE)
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in rows)
    s = PackingSettings(sizes=(32, 64, 128))
    tokens = H.tokenised(df, WORD_BPE, 2).where("token is null").select("doc_id", "n_tokens", "width", "ids")
    bins = written(pack_tokens(tokens, settings=s, shards=shards), "bins")
    got = defaultdict(list)
    for b in bins.collect():
        ids = np.frombuffer(bytes(b["ids"]), "<u4").tolist()
        assert sum(b["lengths"]) == len(ids) and b["bin_size"] == min(x for x in s.sizes if x >= len(ids))
        at = 0
        for doc, k, start, n, offset in zip(b["doc_ids"], b["pieces"], b["starts"], b["lengths"], b["offsets"], strict=True):
            assert offset == at and start == k * 128
            got[doc, k].append(tuple(ids[at : at + n]))
            at += n
    for i, n in Counter(i for i, _ in rows).items():
        if n == 1:
            assert want[i, tuple(x for k in sorted(k for d, k in got if d == i) for x in got[i, k][0])] == 1
    assert sum(n for x in got.values() for n in map(len, x)) == sum(len(x) * n for (_, x), n in want.items())
    for r in places(bins).collect():
        assert any(zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["n_tokens"] for x in got[r["doc_id"], r["piece"]])
    if shards == 1:  # the one shard's bins by brute force over the library's counts
        order = sorted(((i is None, i or 0, len(x), x) for (i, x), n in want.items() for _ in range(n)))
        pieces = [min(128, n - a) for _, _, n, _ in order for a in range(0, n, 128)]
        assert sorted(brute_pack(pieces, s)[2]) == sorted(b["bin_size"] for b in bins.collect())
    assert pack_tokens(tokens.limit(0)).count() == 0


def test_packing_beats_one_sequence_a_bin():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(5.5, 1, 3000).astype(np.int64), 4096)
    bins, offsets, sizes = pack_lengths(lengths, PackingSettings())
    used = np.bincount(bins, weights=lengths, minlength=len(sizes))
    assert (used <= np.array(sizes)).all() and used.sum() / sum(sizes) > 0.98
    again = pack_lengths(lengths, PackingSettings())
    assert (again[0] == bins).all() and (again[1] == offsets).all()


def test_word_counts(spark):
    df, rows = odd_documents(spark)
    got = Counter((r[0], r[1]) for r in df.select("doc_id", word_count(F.col("text")).alias("n")).collect())
    assert got == Counter((i, len(words(t))) for i, t in rows)


def sourced(spark, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, "w " * (k % 7 + 1), k % 7 + 1))
            k += 1
    rows += [(10_000, "empty", None, 0), (None, "a", "x y", 2)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, block int")


def test_mix_meets_entropy_and_repetition(spark):
    df = sourced(spark, {"a": 600, "b": 60, None: 20, "c": 5})
    tokens = {r[0]: r[1] for r in df.groupBy("source").agg(F.sum("block")).collect() if r[1]}
    for s in (MixSettings(entropy=0.8, repeats=100.0), MixSettings(entropy=0.99, repeats=2.0), MixSettings(entropy=0.0), MixSettings(entropy=0.9, repeats=50.0, budget=300)):
        out = temperature_mix(df, settings=s).collect()
        got = defaultdict(int)
        for r in out:
            got[r["source"]] += r["n_tokens"]
        budget = s.budget or sum(tokens.values())
        assert abs(sum(got.values()) - budget) <= 8 * len(tokens)
        share = np.array([got[k] / budget for k in tokens])
        h = -(share[share > 0] * np.log(share[share > 0])).sum() / np.log(len(tokens))
        most = max(got[k] / tokens[k] for k in tokens)
        if s.repeats > 10 and s.entropy:
            assert abs(h - s.entropy) < 0.05
        assert most <= s.repeats + 8 / min(tokens.values())
        for k in tokens:  # whole passes before the last one, whose documents are in the pass's order
            times = Counter(r["epoch"] for r in out if r["source"] == k)
            assert all(n == times[0] for e, n in times.items() if e < max(times))
    assert temperature_mix(df.limit(0)).count() == 0


def test_mixed_documents_keep_their_columns(spark):
    df = sourced(spark, {"a": 50, "b": 3})
    out = mixed_documents(df, settings=MixSettings(entropy=0.9, repeats=5.0))
    assert out.columns == df.columns
    times = Counter(r["doc_id"] for r in out.where("source = 'b'").collect())
    assert len(times) == 3 and max(times.values()) > 1


def test_mixed_documents_leave_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 2}", "KEEP", 7, "x") for i in range(20)], "doc_id long, text string, source string, _mixed_row string, _Mixed_tokens int, _times_of string")
    out = mixed_documents(df, n_tokens=F.lit(3), settings=MixSettings(entropy=0.9, repeats=5.0))
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {("KEEP", 7, "x")}


def test_mixed_documents_hold_each_row_once_a_pass(spark):
    rows = [(None, "a", "x y"), (None, "a", "u v"), (None, "b", "z"), (None, "b", None), (7, "a", "p q"), (7, "a", "r s"), (7, "b", "t"), (8, "a", "x y"), (8, "a", "x y"), (9, None, "o")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    for given in ({"settings": MixSettings(entropy=0.0, budget=30)}, {"settings": MixSettings(entropy=0.0, budget=42), "n_tokens": F.length(df["text"])}):
        # one whole pass and most of another
        got = Counter(tuple(r) for r in mixed_documents(df, **given).collect())
        assert got.keys() == Counter(rows).keys() and all(n <= got[r] <= 2 * n for r, n in Counter(rows).items())
    often = MixSettings(entropy=0.9, repeats=5.0, budget=40)
    got = Counter(r["doc_id"] for r in mixed_documents(df, settings=often).collect())
    assert got == Counter(r["doc_id"] for r in temperature_mix(df, settings=often).collect()) and got[None] > 4
    assert mixed_documents(df.limit(0)).count() == 0


def test_rollup_batches_are_idempotent(spark):
    schema = "source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    rows = spark.createDataFrame([("a", "en", "v1", 10, None), ("a", "en", "v1", 5, None), (None, "de", "v1", None, None)], schema)
    r = TokenRollup(spark, work_path(spark, "rollup"))
    assert r.totals().count() == 0 and r.committed() == []
    assert r.commit("b1", insert_deltas(rows)) and not r.commit("b1", insert_deltas(rows))
    assert r.commit("b2", revise_deltas(spark.createDataFrame([("a", "en", "v1", 7, 5)], schema)))
    assert r.commit("b3", delete_deltas(spark.createDataFrame([(None, "de", "v1", 0, None)], schema)))
    assert r.commit("b4", insert_deltas(rows.limit(0)))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 2, 17)]
    assert r.committed() == ["b1", "b2", "b3", "b4"]
    # a batch that broke off has no success mark and is written anew
    fs, p = r._fs(f"{r._folder('b2')}/_SUCCESS")
    fs.delete(p, False)
    assert [tuple(x) for x in r.totals().where("source = 'a'").collect()] == [("a", "en", "v1", 2, 15)]
    assert r.commit("b2", revise_deltas(spark.createDataFrame([("a", "en", "v1", 7, 5)], schema)))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 2, 17)]
    with pytest.raises(ValueError):
        r.commit("../x", rows)
    # a snapshot has the same totals, in one folder, and remembers its batches
    for more in (None, "b5", "b6"):
        if more:
            assert r.commit(more, insert_deltas(rows))
        before = Counter(tuple(x) for x in r.totals().collect())
        r.compact()
        assert Counter(tuple(x) for x in r.totals().collect()) == before
        assert r._names("batch-") == [] and len(r._names("snapshot-")) == 1 and r._names("draft-") == []
    assert r.committed() == ["b1", "b2", "b3", "b4", "b5", "b6"] and not r.commit("b2", insert_deltas(rows))


def test_rollup_query_equals_counts_by_the_libraries(spark, tmp_path):
    """The query over a small table of its own, against a recount of what is left in the end."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    from glyphgrid.llm.registry import op9_token_rollup

    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b")[i % 2]) for i, t in enumerate(["", None, "One two, three.", "größer als", "x " * 50, "the cat's", "漢字 und mehr", *odd_texts(40)])]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, len(rows), 2)] + [(3, 0, None), (9, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    word = Tokenizer.from_file(WORD_BPE)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mark = {i: (q, t) for i, q, t in labels}
    want = defaultdict(lambda: [0, 0])
    for i, text, lang, source in rows:
        q, t = mark.get(i, (None, None))
        for version, n in (("word_bpe_49k", len(word.encode(text or "", add_special_tokens=False).ids) + (q == 0)), ("byte_bpe_50k", len(byte.encode_ordinary(text or "")))):
            if t != 1:
                want[source, lang, version][0] += 1
                want[source, lang, version][1] += n
    got = {tuple(r)[:3]: [r["n_docs"], r["n_tokens"]] for r in op9_token_rollup(spark, str(tmp_path)).collect()}
    assert got == dict(want)


def test_counts_by_library_tokenizers(spark):
    from tokenizers import Tokenizer

    df, rows = odd_documents(spark, n=20)
    got = Counter(tuple(r) for r in tokenizer_counts(df, {"word": WORD_BPE, "byte": BYTE_BPE}).collect())
    t = {"word": Tokenizer.from_file(WORD_BPE), "byte": Tokenizer.from_file(BYTE_BPE)}
    assert got == Counter((i, v, len(k.encode(x or "", add_special_tokens=False).ids)) for i, x in rows for v, k in t.items())
