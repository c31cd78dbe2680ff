"""Exact top-k by inner product, by distributed histogram selection.

Queries and candidates meet in blocks. Every round scores all of them and keeps, for each query, a histogram of the
scores within the range that holds its k-th best; merged over all blocks it narrows the range, until the k-th value is
known. A last pass emits what reaches that value, and ties go to the smaller id. A block sends only the bins down to
its own k-th best, since the global one can't lie below.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._session import by_key, written
from .embedding_dedup import matrix_rows


@dataclass(frozen=True)
class TopKSettings:
    """k: scores for each query. bins: bins of a histogram. block: candidates, and queries, that meet in one task at a
    time, at most; least: candidates of a block below which it isn't cut further to give every task one.
    scale: components become floor(scale * x)."""

    k: int = 5
    bins: int = 1024
    block: int = 2048
    least: int = 256
    scale: float = 256.0


_LIMIT = (1 << 63) - 1


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers: 64-bit where all fit, else Python's."""
    x = np.floor(values * scale)
    if not len(x) or np.abs(x).max() < 2**62:
        return x.astype(np.int64)
    return np.array([int(v) if np.isfinite(v) else (_LIMIT if v > 0 else -_LIMIT) for v in x], object)


def _prepare(scale: float):
    def run(batches):
        for batch in batches:
            values, starts, lengths = matrix_rows(batch["vector"])
            ids = batch["id"].to_pylist()
            rows = [(i, quantised(values[a : a + n], scale), n) for i, a, n in zip(ids, starts.tolist(), lengths.tolist(), strict=True) if n >= 0 and i is not None]
            big = lambda q: q.dtype == object
            data = [",".join(map(str, q.tolist())).encode() if big(q) else q.tobytes() for _, q, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([big(r[1]) for r in rows], pa.bool_()), pa.array(data, pa.binary())], names=["id", "dim", "big", "data"])

    return run


def _values(table: pa.Table) -> np.ndarray:
    data, big, dim = table["data"].to_pylist(), table["big"].to_pylist(), table["dim"].to_pylist()
    if any(big):
        return np.array([[int(v) for v in x.split(b",")] if b else np.frombuffer(x, np.int64).tolist() for x, b in zip(data, big, strict=True)], object).reshape(len(data), -1)
    return np.frombuffer(b"".join(data), np.int64).reshape(len(data), dim[0] if dim else 0)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exact; those beyond 64 bits are cut to the largest or smallest number."""
    if q.dtype != object and c.dtype != object:
        most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
        if most < 2**53:
            return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        if most < 2**62:
            return q @ c.T
    out = q.astype(object) @ c.astype(object).T
    return np.clip(out, -_LIMIT - 1, _LIMIT).astype(np.int64)


def _meetings(table: pa.Table):
    """For each meeting of a query and a candidate block: query ids, candidate ids and their scores, own pairs apart."""
    where = np.column_stack([table[c].to_numpy() for c in ("dim", "qb", "cb")])
    ids, query = table["id"].to_numpy(), table["query"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((ids, ~query, where[:, 2], where[:, 1], where[:, 0]))
    where, ids, query = where[order], ids[order], query[order]
    table = table.take(pa.array(order))
    head = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1)))
    for a, z in zip(head.tolist(), np.append(head[1:], len(where)).tolist(), strict=True):
        m = int(query[a:z].sum())
        if m in (0, z - a):
            continue
        q, c = _values(table.slice(a, m)), _values(table.slice(a + m, z - a - m))
        for i in range(0, m, 256):
            own, there = ids[a + i : a + min(i + 256, m)], ids[a + m : z]
            yield own, there, scores(q[i : i + 256], c), own[:, None] != there[None, :]


def _extent(key: tuple, table: pa.Table) -> pa.Table:
    """Of each query: candidates, least and greatest score in the shard."""
    out = defaultdict(list)
    for own, _, x, other in _meetings(table):
        n = other.sum(axis=1)
        lo, hi = np.where(other, x, _LIMIT).min(axis=1), np.where(other, x, -_LIMIT - 1).max(axis=1)
        for k, v in (("q", own[n > 0]), ("n", n[n > 0]), ("lo", lo[n > 0]), ("hi", hi[n > 0])):
            out[k].append(v)
    cat = lambda k: pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64), pa.int64())
    return pa.table({k: cat(k) for k in ("q", "n", "lo", "hi")})


def _ranges(table: pa.Table):
    q, lo, width = (table[c].to_numpy(zero_copy_only=False) for c in ("id", "lo", "width"))
    return {int(i): (int(a), int(w)) for i, a, w in zip(q, lo, width, strict=True) if a == a and a is not None}


def _histograms(key: tuple, table: pa.Table, *, s: TopKSettings) -> pa.Table:
    """Of each query: counts of scores in the bins of its range, those above it in bin `bins`, down to the shard's k-th best."""
    at = _ranges(table.filter(table["query"]))
    out = defaultdict(list)
    for own, _, x, other in _meetings(table):
        lo = np.array([at[int(i)][0] for i in own], object)
        width = np.array([max(1, at[int(i)][1]) for i in own], object)
        for r in range(len(own)):
            v = x[r][other[r]]
            if len(v) > s.k:
                v = np.partition(v, len(v) - s.k)[len(v) - s.k :]
            b = [min(s.bins, (int(y) - lo[r]) // width[r]) for y in v.tolist() if y >= lo[r]]
            if b:
                got, n = np.unique(np.array(b, np.int64), return_counts=True)
                out["q"].append(np.full(len(got), own[r])), out["bin"].append(got), out["n"].append(n)
    cat = lambda k: pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64), pa.int64())
    return pa.table({k: cat(k) for k in ("q", "bin", "n")})


def _reached(key: tuple, table: pa.Table, *, s: TopKSettings) -> pa.Table:
    """Pairs whose score reaches the query's k-th value; of ties at it, the k smallest ids of each meeting."""
    at = _ranges(table.filter(table["query"]))
    out = defaultdict(list)
    for own, there, x, other in _meetings(table):
        for r in range(len(own)):
            least = at[int(own[r])][0]
            some = np.flatnonzero((x[r] >= least) & other[r])
            some = some[np.lexsort((there[some], -x[r][some]))][: s.k]
            out["query_id"].append(np.full(len(some), own[r])), out["vec_id"].append(there[some]), out["score"].append(x[r][some])
    cat = lambda k: pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64), pa.int64())
    return pa.table({k: cat(k) for k in ("query_id", "vec_id", "score")})


def exact_topk(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", *, settings: TopKSettings | None = None) -> DataFrame:
    """The k best rows for each query row, of all rows but its own id. queries: a condition on `vectors` that marks them.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the vectors' components as floor(scale * x).
    Ties go to the smaller id. With fewer than k candidates a query has them all.

    Rows without an id, and vectors that are null or hold nulls or values that aren't finite, take no part; vectors of
    another length than the query's aren't its candidates. Rows that repeat an id each count, but no row meets its
    own id. A query id of several different vectors has one list, of the highest scores of any of them: a candidate may stand
    there once for each. Scores beyond 64 bits are cut to the largest or smallest number. An empty table gives none.
    """
    s = settings or TopKSettings()
    spark = vectors.sparkSession
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("query"))
    ready = d.select("id", "vector").mapInArrow(_prepare(s.scale), "id long, dim int, big boolean, data binary")
    ready = written(ready, "quantised")
    marked = written(d.where("query").select("id").distinct(), "queries")
    n = ready.count()
    n_queries = marked.count()
    qbs = max(1, -(-n_queries // s.block))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cbs = max(1, -(-n // s.block), min(-(-tasks // qbs), n // s.least))
    of = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    shard = (F.col("qb").cast("long") * cbs + F.col("cb")).alias("shard")
    asked = written(ready.join(marked, "id").dropDuplicates(["id", "data"]).withColumn("qb", of(qbs, 1)), "asked")
    c = ready.withColumn("cb", of(cbs, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qbs - 1)))).select("id", "dim", "big", "data", "qb", "cb", F.lit(False).alias("query"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("width"))

    def met(state: DataFrame | None) -> DataFrame:
        q = asked if state is None else asked.join(state, "id")
        lo, width = (F.lit(None).cast("long"),) * 2 if state is None else (F.col("lo"), F.col("width"))
        q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cbs - 1)))).select("id", "dim", "big", "data", "qb", "cb", F.lit(True).alias("query"), lo.alias("lo"), width.alias("width"))
        return q.unionByName(c).withColumn("shard", shard).groupBy("shard")

    extent = met(None).applyInArrow(by_key(_extent), "q long, n long, lo long, hi long").groupBy("q").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = (F.col("hi").cast("decimal(38,0)") - F.col("lo").cast("decimal(38,0)") + 1) / s.bins
    # fewer candidates than k: the k-th value is the least
    state = written(extent.select(F.col("q").alias("id"), F.least("n", F.lit(s.k).cast("long")).alias("need"), "lo", F.ceil(span).cast("long").alias("width")), "range")
    while state.where("width > 0").limit(1).count():
        bins = met(state).applyInArrow(by_key(_histograms, s=s), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        w = W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
        narrowed = bins.join(state, bins["q"] == state["id"]).withColumn("above", F.sum("n").over(w)).where("above >= need").groupBy("id").agg(F.max("bin").alias("bin"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("need").alias("need"))
        lo = (F.col("lo").cast("decimal(38,0)") + F.col("bin") * F.col("width").cast("decimal(38,0)")).cast("long")
        width = F.when(F.col("width") <= 1, 0).otherwise(F.ceil(F.col("width") / F.lit(s.bins))).cast("long")
        state = written(narrowed.select("id", "need", lo.alias("lo"), width.alias("width")), "range")
    best = met(state).applyInArrow(by_key(_reached, s=s), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
