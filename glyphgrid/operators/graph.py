"""Connected components: of any edge table, and of the ink of maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) for edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        live = u != v
        if not live.any():
            return nodes, nodes[label]
        x, y, u, v = x[live], y[live], u[live], v[live]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component, without those to itself."""
    nodes, root = forest(a, b)
    keep = nodes != root
    return nodes[keep], root[keep]


def _local(batches):
    parts = [(b["a"].to_numpy(zero_copy_only=False), b["b"].to_numpy(zero_copy_only=False)) for b in batches]
    if parts:
        a, b = star(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)], pa.int64()), pa.array(b[i : i + (1 << 16)], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, *, one_task: int = 1 << 20) -> DataFrame:
    """(id, component) for every node of `edges` (a, b) that isn't the least of its component: the least node reachable.

    Each round, every partition replaces its edges by a forest of stars, so that a node stands in one row of a
    partition at most, however many edges it has. A node then points to the least root that it met, or where that one
    points to. The roots' own pointers, and those of the other roots that met there, are the edges of the next round.
    Once at most `one_task` edges are left, one task ends it. No edges give no rows. Nulls aren't allowed.
    """
    pointers: list[DataFrame] = []
    left = edges.select("a", "b")
    while True:
        stars = written(left.mapInArrow(_local, "a long, b long"), "stars")
        if stars.count() <= one_task:
            out = written(stars.repartition(1).mapInArrow(_local, "a long, b long"), "stars")
            break
        met = written(stars.groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("roots")), "met")
        onward = met.select(F.col("a").alias("b"), F.col("b").alias("_c"))
        met = written(met.join(onward, "b", "left").select("a", F.coalesce("_c", "b").alias("b"), "roots"), "met")
        pointers.append(met.select("a", "b"))
        roots = stars.select(F.col("b").alias("a")).distinct()
        left = met.select(F.explode("roots").alias("a"), "b").unionByName(met.select("a", "b").join(roots, "a", "left_semi")).where("a <> b").distinct()
    for up in reversed(pointers):  # a node's pointer, or what the later rounds made of its target
        later = out.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        own = up.join(later, up["b"] == later["_a"], "left").select("a", F.coalesce("_b", "b").alias("b"))
        out = written(own.unionByName(out.join(up, "a", "left_anti")), "stars")
    return out.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _block_labels(pdf: pd.DataFrame, eight: bool) -> pd.DataFrame:
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    y0, x0 = y.min(), x.min()
    grid = np.full((y.max() - y0 + 3, x.max() - x0 + 3), -1, np.int64)
    grid[y - y0 + 1, x - x0 + 1] = np.arange(len(y))
    ea, eb = [np.arange(len(y))], [np.arange(len(y))]
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if eight else 2]:
        other = grid[y - y0 + 1 + dy, x - x0 + 1 + dx]
        ea.append(np.flatnonzero(other >= 0)), eb.append(other[other >= 0])
    px = pdf["px"].to_numpy()
    order = np.argsort(px, kind="stable")  # so that the least number is the least pixel
    rank = np.empty(len(px), np.int64)
    rank[order] = np.arange(len(px))
    nodes, root = forest(rank[np.concatenate(ea)], rank[np.concatenate(eb)])
    label = np.empty(len(px), np.int64)
    label[nodes] = root
    return pd.DataFrame({"seg_id": pdf["seg_id"], "y": y, "x": x, "label": px[order][label[rank]]})


def label_components(ink: DataFrame, width: int, *, eight: bool = False, block: int = 256) -> DataFrame:
    """Labels of 4- or 8-connected ink: (seg_id, y, x, label), label = least y * width + x of the component.

    Blocks of block x block pixels are labelled by themselves; where ink touches across a border, the two blocks'
    labels are an edge, and the components of these edges join the blocks. No task holds more than a block.
    """
    p = ink.select("seg_id", "y", "x").withColumn("px", F.col("y").cast("long") * width + F.col("x"))
    by = lambda c: F.floor(F.col(c) / block).cast("int")
    p = p.withColumns({"by": by("y"), "bx": by("x")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _block_labels(pdf, eight)

    local = written(p.groupBy("seg_id", "by", "bx").applyInPandas(run, "seg_id string, y int, x int, label long"), "blocks")
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)][: 4 if eight else 2]
    last = lambda c: F.col(c) % block == block - 1
    edge = local.where(last("y") | last("x") | (F.col("x") % block == 0))
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps)))
    to = edge.withColumn("s", step).select("seg_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("label").alias("from"))
    meet = to.join(local, ["seg_id", "y", "x"]).where("`from` <> label")
    # a node is a label with its segment
    node = lambda c: F.concat_ws(":", "seg_id", F.col(c).cast("string"))
    pairs = meet.select("seg_id", "from", "label").distinct()
    ids = written(pairs.select(node("from").alias("n"), "seg_id", F.col("from").alias("label")).unionByName(pairs.select(node("label").alias("n"), "seg_id", "label")).distinct().withColumn("id", F.xxhash64("n")), "nodes")
    found = components(pairs.select(F.xxhash64(node("from")).alias("a"), F.xxhash64(node("label")).alias("b")))
    # the component's label is the least of its blocks' labels
    whole = ids.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = whole.groupBy("component").agg(F.min("label").alias("least"))
    renamed = whole.join(least, "component").select("seg_id", "label", "least")
    return local.join(renamed, ["seg_id", "label"], "left").select("seg_id", "y", "x", F.coalesce("least", "label").alias("label"))


def remove_small(labelled: DataFrame, least: int) -> DataFrame:
    """Drops components of fewer pixels."""
    n = labelled.groupBy("seg_id", "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return labelled.join(n.select("seg_id", "label"), ["seg_id", "label"], "left_semi")


def component_properties(labelled: DataFrame, prob: DataFrame | None = None) -> DataFrame:
    """Area, half-open bounding box, centroid and mean probability of each component."""
    p = labelled if prob is None else labelled.join(prob, ["seg_id", "y", "x"])
    more = [] if prob is None else [F.avg("p").alias("mean_prob")]
    return p.groupBy("seg_id", "label").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), *more)


def hole_counts(labelled: DataFrame) -> DataFrame:
    """Holes of each 4-connected component, from its Euler number: pixels less edges plus full squares."""
    key = ["seg_id", "label"]
    p = labelled.select(*key, "y", "x")
    unit = p.withColumn("s", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, dy, dx in (("p", 0, 0), ("h", 0, 0), ("h", 0, -1), ("v", 0, 0), ("v", -1, 0), ("q", 0, 0), ("q", 0, -1), ("q", -1, 0), ("q", -1, -1))))))
    cells = unit.groupBy(*key, "s.k", (F.col("y") + F.col("s.dy")).alias("cy"), (F.col("x") + F.col("s.dx")).alias("cx")).agg(F.count("*").alias("n"))
    full = lambda k, n: F.count_if((F.col("k") == k) & (F.col("n") == n))
    euler = cells.groupBy(*key).agg((full("p", 1) - full("h", 2) - full("v", 2) + full("q", 4)).alias("euler"))
    return euler.select(*key, "euler", F.greatest(F.lit(0), 1 - F.col("euler")).alias("holes"))
