"""Mixing sources to target weights: temperature, budget and block permutations, in DataFrame operations only.

Each source's share of the tokens is raised to an exponent between 0 (all alike) and 1 (as they are) and normalised.
The exponent is found by bisection: the largest that still reaches the target entropy, unless a source would then be
repeated beyond the limit; then the smallest that keeps to the limit. A weight times the budget is a source's quota: so many
whole passes over it and the beginning of one more. Every pass has its own order, in which the source's blocks are
permuted; a document belongs to a block by the hash of its id, so that no window or task holds a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._counts import word_count
from ._session import free_name, written


@dataclass(frozen=True)
class MixSettings:
    """entropy: target, as a share of the greatest there can be. repeats: passes at most over a source. budget: tokens in
    all; the corpus's own number if None. blocks: of a source. seed: of the permutations."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: int | None = None
    blocks: int = 4096
    seed: int = 1


def _bisected(shares: Column, holds) -> Column:
    """The exponent in [0, 1], after 50 halvings, at which `holds` turns from true to false: the upper end of the true part."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = (at["lo"] + at["hi"]) / 2
        ok = holds(shares, mid)
        return F.struct(F.when(ok, mid).otherwise(at["lo"]).alias("lo"), F.when(ok, at["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda at: (at["lo"] + at["hi"]) / 2)


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def source_weights(sources: DataFrame, s: MixSettings) -> DataFrame:
    """(source, tokens, exponent, weight, quota) from (source, tokens): a row for each source, so one task suffices.

    Sources without tokens get no weight."""
    full = sources.where("tokens > 0").withColumn("budget", F.lit(s.budget).cast("long"))
    one = full.agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("xs"), F.sum("tokens").alias("total"), F.max("budget").alias("budget"))
    one = one.where("total > 0").withColumn("budget", F.coalesce("budget", "total"))
    shares = F.transform("xs", lambda x: x["tokens"].cast("double") / F.col("total").cast("double"))
    target = F.lit(s.entropy) * F.log(F.size("xs").cast("double"))

    def entropy_reached(p: Column, e: Column) -> Column:
        z = _total(p, lambda x: F.pow(x, e))
        return F.log(z) - _total(p, lambda x: F.pow(x, e) * F.log(x)) * e / z >= target

    def too_often(p: Column, e: Column) -> Column:
        # the smallest share is repeated most: share ** (e - 1) / z times budget / total
        z = _total(p, lambda x: F.pow(x, e))
        return F.pow(F.array_min(p), e - 1) / z * F.col("budget") / F.col("total") > F.lit(s.repeats)

    one = one.withColumn("p", shares)
    one = one.withColumn("exponent", F.round(F.greatest(_bisected(F.col("p"), entropy_reached), _bisected(F.col("p"), too_often)), 9))
    z = _total(F.col("p"), lambda x: F.pow(x, F.col("exponent")))
    one = one.withColumn("z", z).select("exponent", "z", "total", "budget", F.explode("xs").alias("x"))
    share = F.col("x.tokens").cast("double") / F.col("total").cast("double")
    out = one.select("x.source", "x.tokens", "exponent", "budget", F.round(F.pow(share, F.col("exponent")) / F.col("z"), 9).alias("weight"))
    return out.select("source", "tokens", "exponent", "weight", F.floor(F.col("weight") * F.col("budget")).cast("long").alias("quota"))


def _md5(*of: Column) -> Column:
    return F.md5(F.concat_ws(":", *(x.cast("string") for x in of)).cast("binary"))


def temperature_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, n_tokens: Column | None = None, settings: MixSettings | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents of each pass: doc_id, source, epoch (from 0), start (tokens of the pass before it), n_tokens, and the
    columns to carry, which also settle the order of rows alike in id and length.

    n_tokens: length of a document; the words of its text if not given. Nulls count 0. A null source is a source of its
    own. A document is in the last pass if it starts within the quota, so a source may exceed it by less than a document.
    Rows that repeat an id stand each for themselves, in the order of their lengths; rows without an id share a block
    by their length. Sources without tokens, and an empty table, give nothing.
    """
    s = settings or MixSettings()
    count = F.coalesce(n_tokens if n_tokens is not None else word_count(F.col(text_col)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count.alias("n_tokens"), *carry)
    key = _md5(F.coalesce(F.col("doc_id"), -F.col("n_tokens")), F.lit(s.seed))
    d = d.withColumn("key", key).withColumn("block", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(s.blocks)).cast("int"))
    d = written(d, "counted")
    blocks = written(d.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    quota = written(source_weights(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), s), "quotas")
    last = F.floor((F.col("quota") - 1) / F.col("q_tokens")).cast("int")
    q = quota.where("quota > 0").select(F.col("source").alias("q_source"), F.col("tokens").alias("q_tokens"), "quota")
    passes = blocks.join(q, F.col("source").eqNullSafe(F.col("q_source"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    # a row for each source, block and pass, however many documents there are
    order = W.partitionBy("source", "epoch").orderBy(_md5(F.col("block"), F.col("epoch"), F.lit(s.seed)), "block").rowsBetween(W.unboundedPreceding, -1)
    passes = passes.withColumn("first", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    limit = F.col("quota") - F.col("epoch") * F.col("q_tokens")
    passes = passes.where(F.col("first") < limit).select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "epoch", "first", limit.alias("limit"))
    within = W.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens", *carry).rowsBetween(W.unboundedPreceding, -1)
    placed = d.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = placed.join(passes, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    start = F.col("first") + F.col("within")
    return out.where(start < F.col("limit")).select("doc_id", "source", "epoch", start.alias("start"), "n_tokens", *carry)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", *, n_tokens: Column | None = None, **given) -> DataFrame:
    """The rows of `docs` as often as the mix has them, each for itself: rows without an id and rows that repeat one too.

    Rows get a number, written once, by which the mix finds them again, in a column of a name that no other has."""
    number, length = free_name("_mixed_row", docs), free_name("_mixed_tokens", docs)
    rows = docs.withColumn(number, F.monotonically_increasing_id())
    if n_tokens is not None:
        rows = rows.withColumn(length, n_tokens)
        n_tokens = F.col(length)
    rows = written(rows, "rows")
    times = temperature_mix(rows, id_col, n_tokens=n_tokens, carry=(number,), **given).select(F.col(number).alias("_times_of"))
    return rows.join(times, rows[number] == times["_times_of"]).select(*(rows[c] for c in docs.columns))
