"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Each pivot of a label has an inverted list
of the vectors that have it among their nearest few; long lists are cut into parts that meet in squares of bounded size.
Within a square, products of incidence matrices count the pivots that two vectors share, each weighed by its ranks with both;
pairs that share enough are candidates, and only these have their cosines computed, in the list of the first pivot that
the two share. Equal vectors are one class. The number of pivots grows with the square root of the vectors, and so do
the lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, star
from ._session import by_key, parts, written
from ._text import column
from .minhash_dedup import squares


@dataclass(frozen=True)
class PivotSettings:
    """cosine: least cosine of a link. density: pivots for each square root of the vectors; least_pivots, most_bytes: bounds
    of their number and of their size, which is sent to all tasks. prefix: nearest pivots in whose lists a vector
    stands. order: nearest ones that describe it. shared: least rank-weighted count of pivots that candidates share, as a
    share of a vector's count with itself. square: vectors on a side of one comparison."""

    cosine: float = 0.93
    density: float = 4.0
    least_pivots: int = 64
    most_bytes: int = 32 << 20
    prefix: int = 8
    order: int = 12
    shared: float = 0.25
    square: int = 256


def matrix_rows(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths) of a column of number lists in double precision; length -1 for rows that take no part:
    null, holding nulls or values that aren't finite."""
    arr = column(col)
    n = len(arr)
    flat = arr.values if hasattr(arr, "values") else arr.flatten()
    off = arr.offsets.to_numpy().astype(np.int64)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts, lengths = off[:-1], np.diff(off)
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    out = arr.is_null().to_numpy(zero_copy_only=False) | (bad[off[1:]] > bad[off[:-1]])
    return values, starts, np.where(out, -1, lengths) if n else lengths


#: Vectors that are looked through for copies at a time.
_FLUSH = 100_000
_NAMES = ["vec_id", "local", "label", "copies", "least", "vector"]
_KINDS = "vec_id long, local long, label long, copies long, least long, vector binary"


def _vectors(batches):
    """Every row with the number of its class among the rows looked at with it; one row of each such class has the vector, the
    number of copies and the least id."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    seen: dict[tuple[int, bytes], int] = {}
    copies: list[int] = []
    least: list[int] = []

    def classes():
        keys = list(seen)
        for i in range(0, len(keys), 10_000):
            part = keys[i : i + 10_000]
            n, m = len(part), i + len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(range(base + i, base + m), pa.int64()), pa.array([x for x, _ in part], pa.int64()), pa.array(copies[i:m], pa.int64()), pa.array(least[i:m], pa.int64()), pa.array([x for _, x in part], pa.binary())], names=_NAMES)

    for batch in batches:
        values, starts, lengths = matrix_rows(batch["embedding"])
        ids, local_of = batch["vec_id"].to_pylist(), []
        for vec, label, a, n in zip(ids, batch["label"].to_pylist(), starts.tolist(), lengths.tolist(), strict=True):
            x = values[a : a + n] + 0.0 if n > 0 else None
            if vec is None or label is None or x is None or not x.any():
                local_of.append(None)
                continue
            at = seen.setdefault((label, x.tobytes()), len(seen))
            if at == len(copies):
                copies.append(0), least.append(vec)
            copies[at] += 1
            least[at] = min(least[at], vec)
            local_of.append(base + at)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(local_of, pa.int64()), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary())], names=_NAMES)
        if len(seen) >= _FLUSH:
            yield from classes()
            base += len(seen)
            seen.clear(), copies.clear(), least.clear()
    yield from classes()


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither large nor small values overflow."""
    return _unit(np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(unit: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first."""
    k = min(order, len(pivots))
    out = np.empty((len(unit), k), np.int32)
    for i in range(0, len(unit), 1024):
        far = -(unit[i : i + 1024] @ pivots.T)
        some = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
        by = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
        out[i : i + 1024] = np.take_along_axis(some, by, axis=1)
    return out


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Pivots spread over the sample: each next one is the row farthest from those chosen, among a random few."""
    if len(sample) <= k:
        return sample
    rng = np.random.default_rng(0)
    chosen = [0]
    close = sample @ sample[0]
    for _ in range(k - 1):
        few = rng.integers(0, len(sample), 16)
        chosen.append(int(few[np.argmin(close[few])]))
        close = np.maximum(close, sample @ sample[chosen[-1]])
    return sample[np.unique(chosen)]


def _pivots_for(dim: int, pivots: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The sample's pivots, or directions drawn at random for a length that the sample doesn't have."""
    if dim not in pivots:
        pivots[dim] = _unit(np.random.default_rng(dim).normal(size=(n, dim)))
    return pivots[dim]


def _index(key: tuple, table: pa.Table, *, pivots: dict[int, np.ndarray], s: PivotSettings) -> pa.Table:
    """One row for each class: a number of its own, its least id, members' local numbers, copies, vector and pivots."""
    vectors, labels = table["vector"].to_pylist(), table["label"].to_numpy()
    local, copies, least = table["local"].to_numpy(), table["copies"].to_numpy(), table["least"].to_numpy()
    by: dict[tuple[int, bytes], list[int]] = {}
    for k, x in enumerate(zip(labels.tolist(), vectors, strict=True)):
        by.setdefault(x, []).append(k)
    rows = list(by.items())
    near: list = [None] * len(rows)
    for n in {len(x) for (_, x), _ in rows}:
        some = [k for k, ((_, x), _) in enumerate(rows) if len(x) == n]
        own = _pivots_for(n // 8, pivots, s.least_pivots)
        for k, p in zip(some, nearest(unit_rows([rows[k][0][1] for k in some]), own, s.order).tolist(), strict=True):
            near[k] = p
    base = key[0].as_py() << 40
    return pa.table({
        "id": pa.array(range(base, base + len(rows)), pa.int64()), "least": pa.array([int(least[v].min()) for _, v in rows], pa.int64()),
        "locals": pa.array([local[v].tolist() for _, v in rows], pa.list_(pa.int64())), "copies": pa.array([int(copies[v].sum()) for _, v in rows], pa.int64()),
        "label": pa.array([k[0] for k, _ in rows], pa.int64()), "vector": pa.array([k[1] for k, _ in rows], pa.binary()), "near": pa.array(near, pa.list_(pa.int32())),
    })


def _candidates(near: np.ndarray, left: int, cross: bool, own: int, s: PivotSettings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (first row before the second, if not across) that share enough pivots and of whose shared lists `own` is the first."""
    n, k = near.shape
    known, at = np.unique(near, return_inverse=True)
    mark = np.zeros((n, len(known)), np.float32)
    weight = np.arange(s.order, s.order - k, -1, dtype=np.float32)
    np.put_along_axis(mark, at.reshape(n, k), np.broadcast_to(weight, (n, k)), 1)
    least = s.shared * float((weight**2).sum())
    if cross:
        p, q = np.nonzero(mark[:left] @ mark[left:].T >= least)
        q = q + left
    else:
        p, q = np.nonzero(np.triu(mark @ mark.T, 1) >= least)
    first = np.empty(len(p), bool)
    lists = near[:, : s.prefix]
    for i in range(0, len(p), 1 << 14):
        x, y = lists[p[i : i + (1 << 14)]], lists[q[i : i + (1 << 14)]]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2)
        first[i : i + (1 << 14)] = np.where(both, x, np.iinfo(np.int32).max).min(axis=1) == own
    return p[first], q[first]


def _close(unit: np.ndarray, p: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs have the cosine."""
    out = np.empty(len(p), bool)
    for i in range(0, len(p), 1 << 14):
        out[i : i + (1 << 14)] = np.einsum("ij,ij->i", unit[p[i : i + (1 << 14)]], unit[q[i : i + (1 << 14)]]) >= least
    return out


def _links(key: tuple, table: pa.Table, *, s: PivotSettings) -> pa.Table:
    """Of the shard's squares: copies linked to each class (kind 0) and links between classes as stars (kind 1)."""
    ids = table["id"].to_numpy()
    where = np.column_stack([table[c].to_numpy() for c in ("cluster", "x", "y", "side")])
    order = np.lexsort((ids, where[:, 3], where[:, 2], where[:, 1], where[:, 0]))
    table, ids, where = table.take(pa.array(order)), ids[order], where[order]
    vectors, own, copies = table["vector"].to_pylist(), table["pivot"].to_numpy(), table["copies"].to_numpy()
    near = table["near"].combine_chunks() if isinstance(table["near"], pa.ChunkedArray) else table["near"]
    flat, cut = near.values.to_numpy(zero_copy_only=False), near.offsets.to_numpy()
    count = np.zeros(len(ids), np.int64)
    ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    head = np.flatnonzero(np.append(True, (where[1:, :3] != where[:-1, :3]).any(axis=1)))
    for a, z in zip(head.tolist(), np.append(head[1:], len(where)).tolist(), strict=True):
        n, cross = z - a, where[a, 1] != where[a, 2]
        left = int((where[a:z, 3] == where[a, 1]).sum()) if cross else n
        if n < 2 or cross and left in (0, n):
            continue
        # a cluster has one length of vectors, and so one number of pivots
        p, q = _candidates(flat[cut[a] : cut[z]].reshape(n, -1), left, cross, int(own[a]), s)
        if not len(p):
            continue
        unit = unit_rows(vectors[a:z])
        linked = _close(unit, p, q, s.cosine)
        p, q = p[linked], q[linked]
        np.add.at(count, a + p, copies[a + q])
        np.add.at(count, a + q, copies[a + p])
        p, q = star(ids[a + p], ids[a + q])
        ea.append(p), eb.append(q)
    a, b = np.concatenate(ea), np.concatenate(eb)
    some = count > 0
    return pa.table({"kind": pa.array(np.repeat([0, 1], [int(some.sum()), len(a)]).astype(np.int32)), "a": pa.array(np.append(ids[some], a), pa.int64()), "b": pa.array(np.append(count[some], b), pa.int64())})


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, settings: PivotSettings | None = None) -> DataFrame:
    """Links vectors of one label whose cosine is `settings.cosine` or more.

    Returns per row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable, its own
    included) and kept (vec_id = component_id).

    Rows without a label or an id, and vectors that are null, empty, zero, or hold nulls or values that aren't finite,
    link with nothing and are their own component, and so do vectors of different lengths. Repeated rows count as other
    rows. Rows with one id and different vectors keep their own links and are in one component. A row without an id
    has no component and is kept. An empty table gives none.
    """
    s = settings or PivotSettings()
    n = parts(vectors)
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = written(d.mapInArrow(_vectors, _KINDS), "vectors")
    own = rows.where("vector is not null").drop("vec_id")
    size = own.agg(F.count("*"), F.max(F.length("vector"))).first()  # one row
    wanted = max(s.least_pivots, int(min(s.density * size[0] ** 0.5, s.most_bytes / max(size[1] or 0, 8))))
    by: dict[int, list[bytes]] = {}
    for (x,) in own.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(2 * wanted).collect():  # twice the bytes of the pivots
        by.setdefault(len(x) // 8, []).append(bytes(x))
    pivots = {dim: choose_pivots(unit_rows(x), wanted) for dim, x in by.items()}
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    index = own.withColumn("shard", shard("label", "vector")).groupBy("shard").applyInArrow(by_key(_index, pivots=pivots, s=s), "id long, least long, locals array<long>, copies long, label long, vector binary, near array<int>")
    index = written(index, "index")
    lists = index.select("id", F.explode(F.slice("near", 1, s.prefix)).alias("pivot"), "label", F.length("vector").alias("dim"))
    lists = lists.select("id", "pivot", F.xxhash64("label", "dim", "pivot").alias("cluster"))
    where = squares(lists.select("id", "cluster"), s.square, n)
    met = where.join(lists.join(index.select("id", "vector", "copies", "near"), "id"), ["id", "cluster"])
    links = met.select("id", "vector", "copies", "near", "pivot", "cluster", "x", "y", "side", "shard").groupBy("shard").applyInArrow(by_key(_links, s=s), "kind int, a long, b long")
    links = written(links, "links")
    counts = links.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    at = rows.where("vector is null").select("vec_id", "local")
    number = index.select(F.col("id").alias("_class"), F.explode("locals").alias("local"))
    held = written(at.join(number, "local", "left"), "held")
    several = held.where("_class is not null").groupBy("vec_id").agg(F.min("_class").alias("a"), F.max("_class").alias("b")).where("a <> b")
    joined = held.join(several.select("vec_id", "a"), "vec_id").select("a", F.col("_class").alias("b")).where("a <> b").distinct()
    found = components(links.where("kind = 1").select("a", "b").unionByName(joined)).withColumnRenamed("id", "_class")
    classes = index.select(F.col("id").alias("_class"), "least", "copies").join(found, "_class", "left").withColumn("component", F.coalesce("component", "_class"))
    classes = classes.join(classes.groupBy("component").agg(F.min("least").alias("component_id")), "component").join(counts.withColumnRenamed("a", "_class"), "_class", "left")
    classes = written(classes.select("_class", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "classes")
    # through the local numbers, so that a class of many rows isn't one key
    out = at.join(number.join(classes, "_class").drop("_class"), "local", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
