"""Prefix trie of conversations: every distinct sequence of first turns is a node.

A prefix is told by its depth and the sum of its turns' digests, each taken with the turn's place, so that running sums give the
digests of all prefixes, and a long conversation is no chain of hashes in one task. The least conversation of each prefix owns
its node. Who owns a prefix owns the longer ones as well, so each conversation's first owned depth is found by binary search:
every round joins one prefix of each open conversation with the prefixes' least members. A conversation's owned
nodes are a chain, which hangs below the node of the prefix before it. A chain is summed from its bottom up; its sums
go to the nodes above through the conversation's own prefixes, all chains at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._order import ranked
from ._session import parts, written

#: Leading turns that a conversation may take from another at most.
_HEAD = 5
_PIECES = ("s0", "s1", "s2", "s3", "s4")


def _turn_digest(depth: Column, role: Column, text_digest: Column) -> list[Column]:
    """160 bits of a turn at its place as five numbers, whose sums stay exact."""
    h = F.sha2(F.concat_ws(":", depth.cast("string"), F.octet_length(role).cast("string"), role, text_digest), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"s{k}") for k in range(len(_PIECES))]


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no from 1, role, digest of the text, its length in code points), rows without a conversation left out."""
    d = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_digest"), F.char_length("text").cast("long").alias("length"))
    d = written(d.withColumn("_tie", F.monotonically_increasing_id()), "turns")
    return ranked(d, ["conv_id"], ["turn", "role", "text_digest", "_tie"]).select("conv_id", F.col("rank").alias("turn_no"), "role", "text_digest", "length")


def heads_replaced(turns: DataFrame, block: int = 100) -> tuple[DataFrame, DataFrame]:
    """Each conversation c rebuilt: the first h turns of conversation c - c % block, then its own after its first h; h is
    crc32(c) % 6. Returns the conversations (conv_id, n_turns) and their turns (conv_id, depth from 1, role, text_digest, length)."""
    turns = written(turns, "ordered")
    own = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string")) % (_HEAD + 1)).cast("long")
    c = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    c = c.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    c = written(c.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "plan")
    head = turns.where(F.col("turn_no") <= _HEAD).withColumnRenamed("conv_id", "base")
    head = c.where("taken > 0").select("conv_id", "base", "taken").join(head, "base").where("turn_no <= taken")
    tail = turns.join(c.select("conv_id", "h", "taken"), "conv_id").where("turn_no > h")
    cols = ("role", "text_digest", "length")
    rows = head.select("conv_id", F.col("turn_no").alias("depth"), *cols).unionByName(tail.select("conv_id", (F.col("turn_no") - F.col("h") + F.col("taken")).alias("depth"), *cols))
    return c.select("conv_id", "n_turns"), rows


def _first_owned(conversations: DataFrame, prefixes: DataFrame, least: DataFrame) -> DataFrame:
    """(conv_id, n_turns, first): the least depth from which on the conversation is the least member; n_turns + 1 if none.
    Binary search: of each open conversation one prefix a round."""
    state = conversations.withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("n_turns") + 1})
    rounds = int(conversations.agg(F.max("n_turns")).first()[0] or 0) + 1
    for _ in range(rounds.bit_length()):
        probe = state.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long"))
        asked = probe.where("lo < hi").select("conv_id", "depth").join(prefixes, ["conv_id", "depth"]).select("conv_id", "depth", "digest")
        answer = asked.join(least.select("depth", "digest", "owner"), ["depth", "digest"]).select("conv_id", (F.col("owner") == F.col("conv_id")).alias("owns"))
        s = probe.join(answer, "conv_id", "left")
        open_, owns = F.col("lo") < F.col("hi"), F.coalesce("owns", F.lit(False))
        state = s.select("conv_id", "n_turns", F.when(open_ & ~owns, F.col("depth") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        state = written(state, "search")
    return state.select("conv_id", "n_turns", F.col("lo").alias("first"))


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each (owner, depth), which stand together in order; one state is held, not the texts."""
    import hashlib

    at, state, done = None, None, []
    for batch in batches:
        for owner, depth, ids in zip(*(batch[c].to_pylist() for c in ("owner", "depth", "ids")), strict=True):
            if (owner, depth) != at:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (owner, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True))), names=["owner", "depth", "ends"])
            done = []
    if at is not None:
        done.append((*at, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True))), names=["owner", "depth", "ends"])


def _ends(members: DataFrame, run: int = 4096) -> DataFrame:
    """(owner, depth, ends): hash of the ids of the conversations that end at a node, numerically in order, comma-joined. Ids of a
    range partition are joined to texts of `run` ids first, so that a node where many end is a few long rows."""
    r = ranked(written(members, "ends"), ["owner", "depth"], ["conv_id"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = r.groupBy("owner", "depth", F.floor((F.col("rank") - 1) / run).alias("chunk")).agg(ids.alias("ids"))
    together = texts.repartition(parts(texts), "owner", "depth").sortWithinPartitions("owner", "depth", "chunk")
    return together.select("owner", "depth", "ids").mapInArrow(_hash_runs, "owner long, depth long, ends string")


def conversation_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of `conversations` (conv_id, n_turns; those without turns are members of the root) and `turns` (conv_id,
    depth from 1 without gaps, role, text_digest, length).

    Returns per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, of the meaning given at `rebuilt_trie`.
    """
    conversations = written(conversations, "members")
    t = turns.select("conv_id", "depth", "length", *_turn_digest(F.col("depth"), F.col("role"), F.col("text_digest")))
    summed = ranked(written(t, "digests"), ["conv_id"], ["depth"], sums=_PIECES)
    digest = F.sha2(F.concat_ws(":", *_PIECES), 256)
    root = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("length"), F.lit("").alias("digest"))
    prefixes = written(summed.select("conv_id", "depth", "length", F.substring(digest, 1, 32).alias("digest")).unionByName(root), "prefixes")
    least = written(prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("length").alias("length")), "least")
    owned = written(_first_owned(conversations, prefixes, least), "chains")

    # chains: nodes from the first owned depth on; a chain hangs below the node before its first
    rows = prefixes.join(owned, "conv_id").select("conv_id", "depth", "digest", "n_turns", "first")
    hang = rows.where("depth = first - 1").join(least.select("depth", "digest", "owner"), ["depth", "digest"])
    hang = written(hang.select("conv_id", "n_turns", "first", F.col("owner").alias("parent"), "depth"), "hang")
    hung = hang.where("first <= n_turns").groupBy(F.col("parent").alias("owner"), "depth").agg(F.count("*").alias("n_hung"))
    nodes = least.join(owned.select(F.col("conv_id").alias("owner"), "n_turns", "first"), "owner").join(hung, ["owner", "depth"], "left")
    n_children = (F.col("depth") < F.col("n_turns")).cast("long") + F.coalesce("n_hung", F.lit(0))
    nodes = nodes.select("owner", "depth", "n_convs", "first", n_children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("length")).alias("saved"))
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("_up", -F.col("depth")), "nodes")

    # a chain summed from its bottom up, and the sums given to all the nodes above it
    chain = ranked(nodes, ["owner"], ["_up"], sums=("saved", "leaf")).select("owner", "depth", F.col("saved").alias("saved_below"), F.col("leaf").alias("leaves_below"))
    chain = written(chain, "sums")
    top = chain.join(owned.select(F.col("conv_id").alias("owner"), F.col("first").alias("depth")), ["owner", "depth"])
    above = rows.where("depth < first").select("conv_id", "depth", "digest").join(top.select(F.col("owner").alias("conv_id"), "saved_below", "leaves_below"), "conv_id")
    above = above.groupBy("depth", "digest").agg(F.sum("saved_below").alias("saved_hung"), F.sum("leaves_below").alias("leaves_hung"))
    hanging = least.select("depth", "digest", "owner").join(above, ["depth", "digest"]).drop("digest")
    parents = hang.select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), "parent")
    # the node where a conversation ends: in its own chain, or, if it owns none, the one that it would hang from
    ends = owned.where("first <= n_turns").select(F.col("conv_id").alias("owner"), F.col("n_turns").alias("depth"), "conv_id").unionByName(hang.where("first > n_turns").select(F.col("parent").alias("owner"), "depth", "conv_id"))
    out = nodes.join(chain, ["owner", "depth"]).join(hanging, ["owner", "depth"], "left").join(parents, ["owner", "depth"], "left").join(_ends(ends), ["owner", "depth"], "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent"))
    return out.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves_below") + F.coalesce("leaves_hung", F.lit(0))).alias("n_leaves"),
        (F.col("saved_below") + F.coalesce("saved_hung", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations (conv_id, turn, role, text), each rebuilt as `heads_replaced` says.

    Returns per node: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null at the root), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, each
    node's (n_convs - 1) times the code points of its last text), ends_sha256 (of the ids of the members that end here,
    ascending, comma-joined; of nothing, the empty string's).

    Turns are in order of `turn`, null first, then of role and text; a null role or text is an empty one. Rows without a
    conversation are left out. A conversation left without turns is a member of the root. Equal conversations share
    all nodes, which the smallest owns. An empty table has no nodes. Further columns play no part, whatever their names.
    """
    return conversation_trie(*heads_replaced(turns_in_order(conversations)))
