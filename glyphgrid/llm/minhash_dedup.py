"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A document takes few hash collections of a few minhashes each; every pair of collections forms the key of one
table, so m collections give m * (m - 1) / 2 tables. Documents with equal sets are one class from the start; blocks
and shards pass on one holder of each table key, so a key held by many documents stays small. Classes that share a
key are candidates and are compared in full, in squares of bounded size, by products of incidence matrices: a small
component of candidates at once; a large one, which chains of chance candidates can make, either at once or bucket by
bucket, whichever compares less, so that the work keeps to the candidate pairs. The components of the confirmed links
are the result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, star
from ._session import by_key, give_back, parts, written
from ._text import U64, bytes_of, chunks, column, lower_ascii, mix, span_hashes, window_hashes, word_spans


@dataclass(frozen=True)
class MinHashSettings:
    """shingle: words of a shingle. percent: least similarity, in hundredths. collections, rows: hash collections and
    minhashes of each; with 14 and 3, a pair at similarity 0.85 is found with probability 0.99996.
    square: documents on a side of one comparison."""

    shingle: int = 5
    percent: int = 85
    collections: int = 14
    rows: int = 3
    square: int = 192


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each shingle, in order; a text of fewer words has one, of all of them; one without words none."""
    low = lower_ascii(data)
    a, z = word_spans(low, off)
    if not len(a):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.searchsorted(a, off)
    h = span_hashes(low, a, z)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    whole = window_hashes(h, width)
    inside = (first[1:][row] >= np.arange(len(a)) + width)[: len(whole)]
    out, of = whole[inside], row[: len(whole)][inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.array([_sequence(h[first[r] : first[r + 1]]) for r in short.tolist()], U64)
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
    return out, of


def _sequence(h: np.ndarray) -> int:
    return int(mix(window_hashes(h, len(h)) + U64(len(h)))[0])


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, n + 1, dtype=U64)
    return mix(at) | U64(1), mix(at + U64(1 << 32))


def sets(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, by row and hash, and their rows."""
    by = np.argsort(h)
    narrow = row[by].astype(np.uint16) if len(row) and row.max() < 1 << 16 else row[by]  # so that the second sort counts
    by = by[np.argsort(narrow, kind="stable")]
    h, row = h[by], row[by]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], row[new]


def _describe(data: np.ndarray, off: np.ndarray, s: MinHashSettings) -> tuple[np.ndarray, ...]:
    """Of each row: size of its set, two digests of it, and its table keys (all 0 without a set)."""
    n = len(off) - 1
    size, digest = np.zeros(n, np.int64), np.zeros((n, 2), U64)
    pairs = [(i, j) for i in range(s.collections) for j in range(i + 1, s.collections)]
    keys = np.zeros((n, len(pairs)), U64)
    factor, change = _seeds(s.collections * s.rows)
    for i, j in chunks(off):
        h, row = sets(*shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], s.shingle))
        if not len(h):
            continue
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        have = i + row[head]
        size[have] = np.diff(np.append(head, len(row)))
        digest[have, 0] = np.add.reduceat(mix(h + U64(1)), head)
        digest[have, 1] = np.add.reduceat(mix(h ^ U64(0x5DEECE66D)), head)
        part = np.empty((s.collections, len(head)), U64)
        for c in range(s.collections):
            got = np.zeros(len(head), U64)
            for k in range(c * s.rows, (c + 1) * s.rows):
                got = mix(got + np.minimum.reduceat((h ^ change[k]) * factor[k], head))
            part[c] = got
        for k, (x, y) in enumerate(pairs):
            keys[have, k] = mix(part[x] * U64(3) + part[y] + U64(k))
    return size, digest, keys


_CLASS = np.dtype([("d", "<u8"), ("e", "<u8"), ("doc", "<i8")])


def _least(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least doc of each row's class, and a mark of one row of each class that has it."""
    order = np.lexsort((every["doc"], every["e"], every["d"]))
    x = every[order]
    first = np.flatnonzero(np.append(True, (x["d"][1:] != x["d"][:-1]) | (x["e"][1:] != x["e"][:-1]))) if len(x) else np.zeros(0, np.int64)
    out, rep = np.empty(len(x), np.int64), np.zeros(len(x), bool)
    out[order] = np.repeat(x["doc"][first], np.diff(np.append(first, len(x))))
    rep[order[first]] = True
    return out, rep


def _signatures(s: MinHashSettings, shards: int):
    def run(batches):
        known, rest = [], []
        for batch in batches:
            data, off = bytes_of(batch["text"])
            size, digest, keys = _describe(data, off, s)
            ids = column(batch["doc_id"])
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            alone = null | (size == 0)
            for k in np.flatnonzero(alone).tolist():
                rest.append((None if null[k] else int(doc[k]), int(size[k])))
            what = np.empty(int((~alone).sum()), _CLASS)
            what["d"], what["e"], what["doc"] = digest[~alone, 0], digest[~alone, 1], doc[~alone]
            known.append((what, size[~alone], keys[~alone]))
        what = np.concatenate([x[0] for x in known]) if known else np.zeros(0, _CLASS)
        size = np.concatenate([x[1] for x in known]) if known else np.zeros(0, np.int64)
        least, rep = _least(what)
        keys = np.concatenate([x[2] for x in known]) if known else np.zeros((0, 1), U64)
        for i in range(0, len(what), 20_000):
            j = min(i + 20_000, len(what))
            r = rep[i:j]
            data = pa.array([k.tobytes() if x else None for k, x in zip(keys[i:j], r.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(what["doc"][i:j], pa.int64()), pa.array(size[i:j], pa.int64()), pa.array(least[i:j], pa.int64()), pa.array((what["d"][i:j] % U64(shards)).astype(np.int32)), pa.array(what["d"][i:j].view(np.int64)), pa.array(what["e"][i:j].view(np.int64)), data], names=_SIGNATURE)
        if rest:
            n = len(rest)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rest], pa.int64()), pa.array([x[1] for x in rest], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=_SIGNATURE)
        del known, rest, what, size, least, rep, keys
        give_back()

    return run


_SIGNATURE = ["doc_id", "n_shingles", "local", "shard", "d", "e", "keys"]
_HELD = np.dtype([("key", "<u8"), ("doc", "<i8")])
_MEMBER = np.dtype([("local", "<i8"), ("d", "<u8"), ("e", "<u8"), ("least", "<i8")])


def _buckets(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Holders by key, each once; first holder of each key; number of holders of each."""
    x = held[np.lexsort((held["doc"], held["key"]))]
    x = x[np.append(True, (x["key"][1:] != x["key"][:-1]) | (x["doc"][1:] != x["doc"][:-1]))] if len(x) else x
    first = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1])) if len(x) else np.zeros(0, np.int64)
    return x, first, np.diff(np.append(first, len(x)))


def _classes(key: tuple, table: pa.Table, *, shards: int) -> pa.Table:
    """Of a shard of class digests: class members (kind 0) and holders of table keys, to the keys' shards (kind 1)."""
    every = np.empty(len(table), _CLASS)
    every["d"], every["e"], every["doc"] = table["d"].to_numpy().view(U64), table["e"].to_numpy().view(U64), table["local"].to_numpy()
    least, rep = _least(every)
    keys = np.frombuffer(b"".join(k for k, r in zip(table["keys"].to_pylist(), rep.tolist(), strict=True) if r), U64).reshape(int(rep.sum()), -1)
    held = np.empty(keys.size, _HELD)
    held["key"], held["doc"] = keys.ravel(), np.repeat(least[rep], keys.shape[1])
    held = held[np.argsort(held["key"], kind="stable")]
    other = every["doc"] != least
    member = np.empty(int(other.sum()), _MEMBER)
    member["local"], member["d"], member["e"], member["least"] = every["doc"][other], every["d"][other], every["e"][other], least[other]
    own = key[0].as_py()
    kind, shard, data = [0], [own], [np.unique(member).tobytes()]
    bounds = np.searchsorted(held["key"], np.array([(k << 64) // shards for k in range(1, shards)], U64))
    for k, x in enumerate(np.split(held, bounds)):
        if len(x):
            kind.append(1), shard.append(k), data.append(x.tobytes())
    return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "data": pa.array(data, pa.binary())})


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """Class members as they are (kind 0: local, least, digests); of the keys of this shard that several classes hold, the
    edges from each to the least (kind 1), and the members (kind 2: bucket, class). Buckets of the same members are one:
    a bucket's number is a hash of them."""
    by = defaultdict(list)
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        by[kind].append(data)
    member = np.frombuffer(b"".join(by[0]), _MEMBER)
    x, first, size = _buckets(np.frombuffer(b"".join(by[1]), _HELD))
    number = np.add.reduceat(mix(x["doc"].astype(U64) + U64(1)), first) if len(first) else np.zeros(0, U64)
    several = np.flatnonzero(size > 1)
    keep = np.zeros(len(size), bool)
    keep[several[np.unique(number[several], return_index=True)[1]]] = True
    row = np.repeat(keep, size)
    doc, bucket = x["doc"][row], np.repeat(number[keep], size[keep]).view(np.int64)
    least = np.repeat(x["doc"][first[keep]], size[keep])
    a, b = star(doc[doc != least], least[doc != least])
    kinds = np.repeat([0, 1, 2], [len(member), len(a), len(doc)]).astype(np.int32)
    none = pa.nulls(len(a) + len(doc), pa.int64())
    return pa.table({
        "kind": pa.array(kinds), "a": pa.array(np.concatenate([member["local"], a, bucket]), pa.int64()), "b": pa.array(np.concatenate([member["least"], b, doc]), pa.int64()),
        "d": pa.chunked_array([pa.array(member["d"].view(np.int64)), none]), "e": pa.chunked_array([pa.array(member["e"].view(np.int64)), none]),
    })


def _overlaps(hashes: list[np.ndarray], left: int, cross: bool) -> np.ndarray:
    """Sizes of the intersections: of all sets, or of the first `left` with the others."""
    sizes = [len(h) for h in hashes]
    every = np.concatenate(hashes)
    row = np.repeat(np.arange(len(hashes)), sizes)
    order = np.argsort(every, kind="stable")
    v = every[order]
    new = np.append(True, v[1:] != v[:-1])
    word = np.cumsum(new) - 1
    often = np.bincount(word) > 1
    keep = often[word]
    word, row = (np.cumsum(often) - 1)[word[keep]], row[order][keep]
    n = len(hashes)
    out = np.zeros((left if cross else n, n - left if cross else n), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        a, z = np.searchsorted(word, (lo, lo + 4096))
        m = np.zeros((n, int(word[z - 1]) - lo + 1), np.float32)
        m[row[a:z], word[a:z] - lo] = 1
        out += m[:left] @ m[left:].T if cross else m @ m.T
    return out


def _verify(key: tuple, table: pa.Table, *, s: MinHashSettings) -> pa.Table:
    """Confirmed links within the shard's squares, as stars."""
    doc = table["doc_id"].to_numpy()
    where = np.column_stack([table[c].to_numpy() for c in ("cluster", "x", "y", "side")])
    order = np.lexsort((doc, where[:, 3], where[:, 2], where[:, 1], where[:, 0]))
    table, doc, where = table.take(pa.array(order)), doc[order], where[order]
    data, off = bytes_of(table["text"])
    have: list[np.ndarray] = []
    for i, j in chunks(off):
        h, row = sets(*shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], s.shingle))
        cut = np.searchsorted(row, np.arange(j - i + 1))
        have += [h[cut[k] : cut[k + 1]] for k in range(j - i)]
    edges_a, edges_b = [], []
    head = np.flatnonzero(np.append(True, (where[1:, :3] != where[:-1, :3]).any(axis=1))) if len(where) else []
    for a, z in zip(head, np.append(head[1:], len(where)), strict=True):
        own, ids = have[a:z], doc[a:z]
        cross = where[a, 1] != where[a, 2]
        left = int((where[a:z, 3] == where[a, 1]).sum()) if cross else 0
        if len(ids) < 2 or cross and left in (0, len(ids)):
            continue
        size = np.array([len(h) for h in own])
        both = np.rint(_overlaps(own, left, cross)).astype(np.int64)
        union = (size[:left, None] + size[None, left:] if cross else size[:, None] + size[None, :]) - both
        i, j = np.nonzero((100 * both >= s.percent * union) & (union > 0))
        p, q = star(ids[i], ids[left + j] if cross else ids[j])
        edges_a.append(p), edges_b.append(q)
    a = np.concatenate(edges_a) if edges_a else np.zeros(0, np.int64)
    b = np.concatenate(edges_b) if edges_b else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def squares(clusters: DataFrame, side: int, shards: int) -> DataFrame:
    """(id, cluster, x, y, side, shard): where members of a cluster meet. A cluster of more than `side` is cut into parts
    by the hash of the id, and every two parts meet in a square of their own."""
    big = written(clusters.groupBy("cluster").count().where(F.col("count") > side).select("cluster", F.ceil(F.col("count") / side).cast("int").alias("n")), "sizes")
    d = clusters.join(big, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    d = d.withColumn("side", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    d = d.select("id", "cluster", F.least("side", "other").cast("int").alias("x"), F.greatest("side", "other").cast("int").alias("y"), "side")
    return d.withColumn("shard", F.pmod(F.xxhash64("cluster", "x", "y"), F.lit(shards)).cast("int"))


def _groups(near: DataFrame, buckets: DataFrame, side: int) -> DataFrame:
    """(id, cluster): which classes to compare with which. The components of candidates, but of those of more than `side`
    classes that take more comparisons than all their buckets together the buckets."""
    nodes = near.select("id", F.col("component").alias("cluster")).unionByName(near.select(F.col("component").alias("id"), F.col("component").alias("cluster")).distinct())
    nodes = written(nodes, "clusters")
    large = nodes.groupBy("cluster").count().where(F.col("count") > side)
    inside = written(buckets.join(nodes.join(large.select("cluster"), "cluster", "left_semi"), "id").distinct(), "buckets")
    work = inside.groupBy("cluster", "bucket").count().groupBy("cluster").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("work"))
    split = work.join(large, "cluster").where(F.col("work") < F.col("count").cast("double") * F.col("count")).select("cluster")
    split = written(split, "split")
    return written(nodes.join(split, "cluster", "left_anti").select("id", "cluster").unionByName(inside.join(split, "cluster", "left_semi").select("id", F.xxhash64("cluster", "bucket").alias("cluster"))), "groups")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, settings: MinHashSettings | None = None) -> DataFrame:
    """Links documents whose sets of word shingles have a similarity of `settings.percent` hundredths or more.

    Returns per row: doc_id, n_shingles (size of the set), component_id (smallest id reachable over links, its own
    included), kept (doc_id = component_id). Letters A-Z count as a-z; words are runs of bytes other than blank, tab,
    line and page ends. A text of fewer words than a shingle has one shingle of all of them. Shingles are told apart by
    64-bit hashes.

    A null, empty or wordless text has an empty set and links with nothing. Rows with one id are one document whose
    links are those of all its rows, and each row is returned. A row without an id links with nothing, has no component
    and is kept. An empty table gives none.
    """
    s = settings or MinHashSettings()
    n = parts(docs)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(d.mapInArrow(_signatures(s, n), "doc_id long, n_shingles long, local long, shard int, d long, e long, keys binary"), "signatures")
    held = signed.where("keys is not null").groupBy("shard").applyInArrow(by_key(_classes, shards=n), "kind int, shard int, data binary")
    met = written(held.groupBy("shard").applyInArrow(by_key(_meet), "kind int, a long, b long, d long, e long"), "candidates")
    members = met.where("kind = 0").select(F.col("a").alias("local"), F.col("b").alias("_class"), "d", "e")
    near = components(met.where("kind = 1").select("a", "b"))
    groups = _groups(near, met.where("kind = 2").select(F.col("a").alias("bucket"), F.col("b").alias("id")), s.square)
    where = squares(groups, s.square, n)
    texts = where.join(d.where("doc_id is not null").withColumnRenamed("doc_id", "id"), "id").select(F.col("id").alias("doc_id"), "text", "cluster", "x", "y", "side", "shard")
    links = texts.groupBy("shard").applyInArrow(by_key(_verify, s=s), "a long, b long")
    # an id that stands in several classes joins them
    own = signed.where("d is not null").select("doc_id", "local", "d", "e")
    several = own.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("d", "e") for f in (F.min, F.max))).where("min_d <> max_d or min_e <> max_e").select("doc_id")
    joined = own.join(written(several, "several"), "doc_id", "left_semi").join(members, ["local", "d", "e"], "left").select(F.col("doc_id").alias("a"), F.coalesce("_class", "local").alias("b")).where("a <> b").distinct()
    out = signed.select("doc_id", "n_shingles", "local", "d", "e").join(members, ["local", "d", "e"], "left").withColumn("_class", F.coalesce("_class", "local", "doc_id"))
    found = components(links.unionByName(joined))
    out = out.join(found.select(F.col("id").alias("_class"), "component"), "_class", "left")
    component = F.coalesce("component", "_class")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
