"""Text lines: clustering by anchors, gaps, bands and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def line_anchors(candidates: DataFrame, by: list[str], factor: float = 1.5) -> DataFrame:
    """(by..., line_id, anchor, heights): a line begins at the first candidate more than `factor` median heights below the
    last line's first, and has the heights from there to the next line's. Only distinct heights take part in the fold, so
    its state is one number and the anchors."""
    g = candidates.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("cy").cast("double"))).alias("ys"), F.median("h").alias("mh")) if by else candidates.agg(F.array_sort(F.collect_set(F.col("cy").cast("double"))).alias("ys"), F.median("h").alias("mh"))
    start = F.array().cast("array<double>")
    far = lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > F.col("mh") * factor), F.concat(acc, F.array(y))).otherwise(acc)
    a = g.select(*by, "ys", F.aggregate("ys", start, far).alias("anchors"))
    a = a.select(*by, "ys", "anchors", F.posexplode("anchors").alias("line_id", "anchor"))
    place = lambda y: F.array_position("ys", y)
    after = F.coalesce(place(F.get("anchors", F.col("line_id") + 1)), F.size("ys") + 1)
    first = place(F.col("anchor"))
    return a.select(*by, "line_id", "anchor", F.slice("ys", first.cast("int"), (after - first).cast("int")).alias("heights"))


def text_lines(candidates: DataFrame, by: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Adds line_id (from the top) and pos_in_line (from the left; ties by id). by: columns of a page, such as a segment.

    Every distinct height of a page has its line, so that the join is one of equal pages and heights."""
    by = by or []
    at = line_anchors(candidates, by, factor).select(*by, "line_id", F.explode("heights").alias("_y"))
    out = candidates.withColumn("_y", F.col("cy").cast("double")).join(at, [*by, "_y"]).drop("_y").select(*candidates.columns, "line_id")
    return out.withColumn("pos_in_line", F.row_number().over(W.partitionBy(*by, "line_id").orderBy("cx", "id")))


def line_stats(lined: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Candidates, mean height on the page, median width and median height of each line."""
    return lined.groupBy(*(by or []), "line_id").agg(F.count("*").alias("n"), F.avg("cy").alias("line_y"), F.median("w").alias("median_w"), F.median("h").alias("median_h"))


def line_size_summary(lined: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Smallest, median and largest number of candidates on a line."""
    n = lined.groupBy(*(by or []), "line_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"), F.count("*").alias("lines"))


def gaps(lined: DataFrame, by: list[str] | None = None, factor: float = 2.5) -> DataFrame:
    """Neighbours on a line more than `factor` median widths apart, with the number of characters missing."""
    by = by or []
    widths = lined.groupBy(*by, "line_id").agg(F.median("w").alias("median_w"))
    before = F.lag("cx").over(W.partitionBy(*by, "line_id").orderBy("cx", "id"))
    d = lined.withColumn("prev_x", before).join(widths, [*by, "line_id"]).withColumn("gap", F.col("cx") - F.col("prev_x"))
    return d.where(F.col("gap") > factor * F.col("median_w")).select(*by, "line_id", "id", "prev_x", "cx", "gap", S.gap_missing(F.col("gap"), F.col("median_w")).alias("missing"))


def active_lines(lined: DataFrame, by: list[str] | None = None, *, skip_all_high: bool = True) -> DataFrame:
    """Lines with a candidate of medium confidence or a large gap."""
    line = [*(by or []), "line_id"]
    medium = lined.groupBy(*line).agg(F.bool_or(S.tier(F.col("mean_prob")) == "MEDIUM").alias("medium"))
    with_gap = gaps(lined, by).select(*line).distinct().withColumn("gap", F.lit(True))
    out = medium.join(with_gap, line, "left").select(*line, "medium", F.coalesce("gap", F.lit(False)).alias("gap"))
    return out.where(F.col("medium") | F.col("gap")) if skip_all_high else out


def batches(lines: DataFrame, size: int = 5, by: list[str] | None = None) -> DataFrame:
    """Batch number of each line of a page, in their order; a page's lines are few. Without `by`, all are one page."""
    return lines.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy("line_id")) - 1) / size).cast("int"))


def row_bands(profile: DataFrame, height: DataFrame, *, least: int = 20, pad: int = 10) -> DataFrame:
    """Bands of consecutive rows with ink, of `least` rows at least, widened by `pad` within the page. A run that reaches the
    last row is not a band."""
    ink = profile.where("ink > 0")
    g = ink.withColumn("run", F.col("y") - F.row_number().over(W.partitionBy("seg_id").orderBy("y")))
    runs = g.groupBy("seg_id", "run").agg(F.min("y").alias("a"), (F.max("y") + 1).alias("z"))
    out = runs.join(height, "seg_id").where((F.col("z") - F.col("a") >= least) & (F.col("z") < F.col("h")))
    return out.select("seg_id", F.greatest(F.lit(0), F.col("a") - pad).alias("y0"), F.least(F.col("h"), F.col("z") + pad).alias("y1"))


def prompt_entries(lined: DataFrame, matches: DataFrame | None, width: int, by: list[str] | None = None) -> DataFrame:
    """Prompt lines: (by..., line_id, ord, entry). matches: (by..., id, letter, rank, score); high candidates show their best letter,
    medium ones the softmax of their first three; gaps stand before the candidate that follows them."""
    by = by or []
    line, one = [*by, "line_id"], [*by, "id"]
    pos = lambda c: c / F.greatest(F.lit(width), F.lit(1))
    w = W.partitionBy(*line).orderBy("cx", "id")
    ord_ = lined.withColumn("ord", F.row_number().over(w)).withColumn("tier", S.tier(F.col("mean_prob")))
    g = gaps(lined, by).select(*line, "id", F.format_string("  pos %s: GAP  (~%d char missing)", S.fixed(pos((F.col("prev_x") + F.col("cx")) / 2.0), 3), "missing").alias("entry"))
    gap = g.join(ord_.select(*one, "ord"), one).select(*line, (F.col("ord") * 2 - 1).alias("ord"), "entry")
    if matches is None:
        return gap
    m = matches.where("rank <= 3").groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("rank", "letter", "score"))).alias("m"))
    probs = S.softmax(F.transform("m", lambda x: x["score"]))
    choices = F.array_join(F.zip_with("m", probs, lambda x, p: F.concat(x["letter"], F.lit(" "), S.fixed(p, 2))), " | ")
    high = F.format_string("  pos %s: HIGH → %s  (score %s)", S.fixed(pos(F.col("cx")), 3), F.element_at("m", 1)["letter"], S.fixed(F.element_at("m", 1)["score"], 2))
    med = F.format_string("  pos %s: MED  → %s", S.fixed(pos(F.col("cx")), 3), choices)
    c = ord_.join(m, one).select(*line, (F.col("ord") * 2).alias("ord"), F.when(F.col("tier") == "HIGH", high).when(F.col("tier") == "MEDIUM", med).alias("entry"))
    return gap.unionByName(c.where("entry is not null"))


def line_prompts(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One prompt for each line."""
    g = entries.groupBy(*(by or []), "line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda e: e["entry"]), "\n").alias("ctx"))
    return g.select(*(by or []), "line_id", F.concat(F.lit("Line "), F.col("line_id").cast("string"), F.lit(":\n"), "ctx").alias("prompt"))


def batch_prompts(prompts: DataFrame, size: int = 5, by: list[str] | None = None) -> DataFrame:
    """One message for each batch of lines of a page."""
    b = batches(prompts, size, by).groupBy(*(by or []), "batch").agg(F.array_sort(F.collect_list(F.struct("line_id", "prompt"))).alias("ps"))
    return b.select(*(by or []), "batch", F.transform("ps", lambda p: p["line_id"]).alias("line_ids"), F.array_join(F.transform("ps", lambda p: p["prompt"]), "\n\n---\n\n").alias("message"))
