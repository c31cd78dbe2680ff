"""Merkle manifest of a dataset: iterative DataFrame levels over row numbers, and proofs from per-level joins.

Rows are leaves, in order within their group. Going up, nodes are grouped by their number divided by the fanout, and the
sorted array of children is hashed into the parent; one pass climbs `levels` levels at once, on groups of fanout ** levels
nodes. When every group of rows has come down to its subroot, the subroots are climbed in the same way to the root.
Going down, each pass joins its groups with the proofs of the nodes that they became and appends the siblings. Nothing but
node rows is shuffled: a leaf carries its id and digests, never its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._order import ranked
from ._session import written

_DIGEST = 64


def encoded(c: Column) -> Column:
    """A value in a leaf: `-` if null, else its number of UTF-8 bytes, a colon, and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def _lowered(nodes: Column, fanout: int) -> Column:
    """Digests of each run of `fanout` consecutive digests."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / fanout).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))


def _climb(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """`nodes` (key, n, index, hash and what a leaf carries; n nodes have the key) to one node a key. Returns the groups of
    each pass, with the digests of their inner levels, and the last nodes."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    passes = []
    carried = [c for c in nodes.columns if c not in ("key", "n", "index")]
    while True:
        group = F.floor(F.col("index") / F.lit(fanout**levels)).cast("long")
        children = F.transform(F.array_sort(F.collect_list(F.struct("index", *carried))), lambda x: F.struct(*(x[c].alias(c) for c in carried)))
        g = nodes.groupBy("key", group.alias("index")).agg(F.first("n").alias("n"), children.alias("children"))
        # one column for each level: digests, and how many nodes the whole key has there
        g = g.withColumn("l0", F.col("children.hash")).withColumn("n0", F.col("n"))
        for j in range(levels):
            g = g.withColumn(f"l{j + 1}", F.when(F.col(f"n{j}") > 1, _lowered(F.col(f"l{j}"), fanout)).otherwise(F.col(f"l{j}")))
            g = g.withColumn(f"n{j + 1}", F.when(F.col(f"n{j}") > 1, F.ceil(F.col(f"n{j}") / fanout)).otherwise(F.col(f"n{j}")).cast("long"))
        g = written(g, "merkle")
        passes.append(g)
        nodes = g.select("key", F.col(f"n{levels}").alias("n"), "index", F.col(f"l{levels}")[0].alias("hash"))
        carried = ["hash"]
        for _ in range(levels):
            most = -(-most // fanout)
        if most <= 1:
            return passes, nodes


def _descend(passes: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first pass's children with the proofs (arrays of place in the run and siblings' digests, from below) that lead to
    `tops` (key, index, path and further columns of the top), whose proofs they go on with."""
    for depth, g in enumerate(reversed(passes)):
        further = [c for c in tops.columns if c not in ("key", "index")]
        t = tops.select(F.col("key").alias("_key"), F.col("index").alias("_index"), *further)
        d = g.join(t, g["key"].eqNullSafe(t["_key"]) & (g["index"] == t["_index"])).select(g["*"], *further)
        d = d.select("*", F.posexplode("children").alias("_i", "_child"))
        steps = []
        for j in range(levels):
            at = F.floor(F.col("_i") / F.lit(fanout**j)).cast("int")
            place = at % fanout
            run = F.slice(F.col(f"l{j}"), at - place + 1, F.lit(fanout))
            others = F.concat(F.slice(run, F.lit(1), place), F.slice(run, place + 2, F.lit(fanout)))
            steps.append(F.when(F.col(f"n{j}") > 1, F.struct(place.alias("place"), F.array_join(others, "").alias("others"))))
        path = F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), F.col("path"))
        rest = [c for c in further if c != "path"]
        out = d.select("key", (F.col("index") * F.lit(fanout**levels) + F.col("_i")).alias("index"), "_child.*", path.alias("path"), *rest)
        last = depth == len(passes) - 1
        tops = out if last else written(out.drop("hash"), "proofs")
    return tops


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(h: Column, s: Column) -> Column:
        cut = s["place"] * _DIGEST
        return F.sha2(F.concat(F.substring(s["others"], F.lit(1), cut), h, F.substring(s["others"], cut + 1, F.length(s["others"]))), 256)

    return F.aggregate(path, leaf, step)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", *, altered: dict[str, Column] | None = None, fanout: int = 2, levels: int = 4) -> DataFrame:
    """A leaf for each row, a tree for each value of `group`, a tree over their subroots, and a proof for each leaf.

    Returns per row: the columns `order` and `group`, leaf, subroot, root, path (array of place, others: the place in each run
    and the digests of its other nodes, end to end, from the leaf to the root), and altered_leaf. Digests are lowercase
    hexadecimal SHA-256 of their inputs' concatenation; a leaf's inputs are its columns, `-` if null, else byte count, colon
    and value. Every `fanout` consecutive nodes become one while several remain, the last run being shorter, even one node;
    a lone leaf is its subroot, a lone subroot the root. Groups are in order of their values, null first, by bytes.
    `altered` replaces columns for altered_leaf, null where the leaf stays as it is.

    Nulls are values of their own: rows without an id come first in their group, rows without a group form one. Rows of
    one id stand in order of their leaves; equal rows are leaves beside each other, each with its proof. An empty text
    is no null text. An empty table has no rows and no root. Further columns play no part, whatever their names.
    """
    now = [F.col(c) for c in columns]
    then = [(altered or {}).get(c, F.col(c)) for c in columns]
    leaf, other = leaf_hash(*now), leaf_hash(*then) if altered else F.lit(None).cast("string")
    d = docs.select(F.col(group).alias("key"), F.col(order).alias("id"), leaf.alias("hash"), other.alias("altered"))
    d = written(d.withColumn("altered", F.when(F.col("altered") != F.col("hash"), F.col("altered"))).withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    counts = written(d.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").alias("_of"), "n"), "groups")
    r = ranked(d, ["key"], ["id", "hash", "_tie"])
    r = r.join(counts, r["key"].eqNullSafe(counts["_of"])).select("key", "n", (F.col("rank") - 1).alias("index"), "hash", "id", "altered")
    passes, tops = _climb(r, fanout, levels)
    # the tree over the subroots, whose leaves carry the group that they stand for
    subroots = written(tops.select(F.lit(0).alias("one"), F.col("key").alias("group"), F.col("hash")), "subroots")
    n = subroots.count()
    over = ranked(subroots, ["one"], ["group"]).select(F.col("one").alias("key"), F.lit(n).cast("long").alias("n"), (F.col("rank") - 1).alias("index"), "hash", "group")
    upper, root = _climb(over, fanout, levels)
    ends = root.select("key", "index", F.col("hash").alias("root"), F.expr("cast(array() as array<struct<place int, others string>>)").alias("path"))
    groups = _descend(upper, ends, fanout, levels)
    groups = written(groups.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("index"), F.col("hash").alias("subroot"), "root", "path"), "proofs")
    out = _descend(passes, groups, fanout, levels)
    return out.select(F.col("id").alias(order), F.col("key").alias(group), F.col("hash").alias("leaf"), "subroot", "root", "path", F.col("altered").alias("altered_leaf"))


def proof_digests(manifest: DataFrame, order: str = "doc_id") -> DataFrame:
    """Per leaf of a manifest: id, leaf, subroot, root, proof_sha256 (of all siblings on the way to the root), folded_root (from
    the altered leaf where there is one, by the original siblings), verified (whether that is the root)."""
    d = manifest.withColumn("folded_root", folded(F.coalesce("altered_leaf", "leaf"), F.col("path")))
    proof = F.sha2(F.array_join(F.col("path.others"), ""), 256)
    return d.select(order, "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
