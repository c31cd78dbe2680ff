"""Reductions over axes, thresholds, masks and statistics of rasters.

A volume is (seg_id, z, y, x, v), a map (seg_id, y, x, p); all are plain aggregations, so that partial sums are made
before the shuffle, and filters and column lists reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip, tier
from ..session import written


def min_max_normalised(vox: DataFrame, z_start: int, z_end: int) -> DataFrame:
    """v scaled to [0, 1] by its segment's range over layers [z_start, z_end); a constant volume keeps its values."""
    part = vox.where((F.col("z") >= z_start) & (F.col("z") < z_end)).select("seg_id", "z", "y", "x", F.col("v").cast("double").alias("v"))
    span = part.groupBy("seg_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return part.join(span, "seg_id").select("seg_id", "z", "y", "x", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("v")).alias("v"))


def derive_mask(vox: DataFrame) -> DataFrame:
    return vox.groupBy("seg_id", "y", "x").agg((F.max("v") > 0).alias("mask"))


def with_mask(pixels: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Adds `mask`; without one, or where it has no row, it is true."""
    if mask is None:
        return pixels.withColumn("mask", F.lit(True))
    return pixels.join(mask, ["seg_id", "y", "x"], "left").withColumn("mask", F.coalesce("mask", F.lit(True)))


def scaled_map(pixels: DataFrame, value: str, *, above: float = 1.5, clipped: bool = True) -> DataFrame:
    """A map whose values may be bytes: divided by 255 where its segment's largest exceeds `above`, clipped if asked."""
    top = pixels.groupBy("seg_id").agg(F.max(value).alias("_top"))
    v = F.when(F.col("_top") > above, F.col(value) / 255.0).otherwise(F.col(value).cast("double"))
    return pixels.join(top, "seg_id").select("seg_id", "y", "x", (clip(v) if clipped else v).alias("p"))


def crop(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Half-open window; coordinates become relative to it."""
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return pixels.where(inside).withColumns({"y": (F.col("y") - y0).cast("int"), "x": (F.col("x") - x0).cast("int")})


def parse_crop(text: str) -> tuple[int, int, int, int]:
    y0, y1, x0, x1 = (int(v) for v in text.split(","))
    return y0, y1, x0, x1


def mask_bounds(pixels: DataFrame, condition: Column, *, inclusive: bool = True) -> DataFrame:
    """Bounding box of the pixels that hold, a row for each segment; with `inclusive`, y1 and x1 lie behind the last."""
    more = 1 if inclusive else 0
    return pixels.where(condition).groupBy("seg_id").agg(F.min("y").alias("y0"), (F.max("y") + more).alias("y1"), F.min("x").alias("x0"), (F.max("x") + more).alias("x1"))


def crop_to_mask(pixels: DataFrame, condition: Column, **given) -> DataFrame:
    b = mask_bounds(pixels, condition, **given)
    return pixels.join(b, "seg_id").where("y >= y0 and y < y1 and x >= x0 and x < x1").drop("y0", "y1", "x0", "x1")


def strided(pixels: DataFrame, step: int, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Every step-th pixel along the axes, renumbered."""
    out = pixels
    for a in axes:
        out = out.where(F.col(a) % step == 0).withColumn(a, (F.col(a) / step).cast("int"))
    return out


def projections(vox: DataFrame, value: str = "v") -> DataFrame:
    """Maximum and mean along each axis at once: axis, seg_id, a, b, top, mean (a, b: the other two axes in order z, y, x)."""
    g = vox.groupingSets([["seg_id", "y", "x"], ["seg_id", "z", "x"], ["seg_id", "z", "y"]], "seg_id", "z", "y", "x")
    out = g.agg(F.max(value).alias("top"), F.avg(value).alias("mean"))
    axis = F.when(F.col("z").isNull(), "axial").when(F.col("y").isNull(), "coronal").otherwise("sagittal")
    return out.select(axis.alias("axis"), "seg_id", F.coalesce("z", "y").alias("a"), F.when(F.col("x").isNotNull(), F.col("x")).otherwise(F.col("y")).alias("b"), "top", "mean")


def _value_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value between two bounds, which never share one. Bounds of different sign or size are cut by the sign and the power of
    two, so that after one such round few more in equal parts are left; infinite values have bins of their own."""
    power = F.floor(F.least(F.greatest((F.log2(F.abs(v)) + 1075) / 2100, F.lit(0.0)), F.lit(1.0)) * 1023)
    steep = F.when(v == float("inf"), 2050).when(v == float("-inf"), -1).when(v == 0, 1024).when(v > 0, 1025 + power).otherwise(1023 - power)
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    even = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return F.when((F.signum(lo) != F.signum(hi)) | (large == float("inf")) | (small * 4096 < large), steep).otherwise(even).cast("int")


def exact_percentiles(pixels: DataFrame, value: str, shares: dict[str, float], *, bins: int = 1024) -> DataFrame:
    """Exact percentiles of each segment, between two values where the place falls between them: seg_id and a column for each
    of `shares` (name -> share in [0, 1]).

    Histograms, refined: each round counts the values between two bounds in `bins` bins, and takes the least and the
    largest value of the bin that holds the place as the next bounds, until they are one value. Partial counts are made
    before the shuffle, and no state is larger than bins x places x segments, however many values differ. Nulls and NaN
    are left out; a segment of nothing else has no row. Infinite values are as any other.
    """
    v = pixels.select("seg_id", F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    span = v.groupBy("seg_id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.lit(up).alias("up")) for name, q in shares.items() for up in (0, 1))))
    at = F.col("a.q") * (F.col("n") - 1)
    t = span.withColumn("a", asked).select("seg_id", "a.name", "a.up", (at - F.floor(at)).alias("part"), F.when(F.col("a.up") == 1, F.ceil(at)).otherwise(F.floor(at)).cast("long").alias("rank"), "lo", "hi")
    key = ["seg_id", "name", "up"]
    t = written(t, "places")
    while True:
        # places that lie between the same bounds share one histogram
        bounds = t.where("lo < hi").select("seg_id", "lo", "hi").distinct()
        if bounds.isEmpty():
            break
        b = _value_bin(F.col("v"), F.col("lo"), F.col("hi"), bins)
        counted = v.join(bounds, "seg_id").where("v >= lo and v <= hi").groupBy("seg_id", "lo", "hi", b.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        w = W.partitionBy("seg_id", "lo", "hi").orderBy("bin")
        counted = written(counted.withColumn("upto", F.sum("c").over(w)), "histogram")
        inside = t.where("lo < hi").join(counted, ["seg_id", "lo", "hi"]).where("rank >= upto - c and rank < upto")
        refined = inside.select(*key, "part", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        t = written(t.where("lo >= hi").unionByName(refined), "places")
    low, high = F.max(F.when(F.col("up") == 0, F.col("lo"))), F.max(F.when(F.col("up") == 1, F.col("lo")))
    got = t.groupBy("seg_id", "name").agg(low.alias("a"), high.alias("b"), F.max("part").alias("part"))
    value_ = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    return got.groupBy("seg_id").agg(*(F.max(F.when(F.col("name") == name, value_)).alias(name) for name in shares))


def depth_map(vox: DataFrame, keep: float = 0.8) -> DataFrame:
    """First layer of the largest value, kept where that value exceeds the segment's percentile `keep`; else null."""
    top = vox.groupBy("seg_id", "y", "x").agg(F.max("v").alias("mip"), F.max_by("z", F.struct("v", -F.col("z"))).alias("depth"))
    top = written(top, "tops")
    cut = exact_percentiles(top, "mip", {"cut": keep})
    return top.join(cut, "seg_id").select("seg_id", "y", "x", "mip", F.when(F.col("mip") > F.col("cut"), F.col("depth")).alias("depth"))


def layer_stats(vox: DataFrame, where: Column | None = None) -> DataFrame:
    v = vox if where is None else vox.where(where)
    return v.groupBy("seg_id", "z").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def percentile_normalised(pixels: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Values scaled to [0, 1] between two exact percentiles of their segment."""
    cut = exact_percentiles(pixels, value, {"_lo": lo, "_hi": hi})
    return pixels.join(cut, "seg_id").withColumn("p", clip((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8))).drop("_lo", "_hi")


def histogram(pixels: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts in bins of equal width; the last is closed on the right, values outside are left out."""
    inside = pixels.where((F.col(value) >= lo) & (F.col(value) <= hi))
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return inside.groupBy("seg_id", b.alias("bin")).agg(F.count("*").alias("n"))


def segment_summary(vox: DataFrame, z: int) -> DataFrame:
    """Height, width, valid pixels, coverage in percent, and mean and deviation of the valid pixels of one layer."""
    valid = F.when(F.col("v") > 0, F.col("v"))
    return vox.where(F.col("z") == z).groupBy("seg_id").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count(valid).alias("valid_px"), (F.count(valid) / F.count("*") * 100).alias("coverage_pct"), F.avg(valid).alias("mean"), F.stddev_pop(valid).alias("std")
    )


def threshold_coverage(prob: DataFrame, levels: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Pixels above each level and their share, from one pass: a row for each segment and level."""
    counts = prob.groupBy("seg_id").agg(F.count("*").alias("_n"), *(F.count_if(F.col("p") > t).alias(f"_{i}") for i, t in enumerate(levels)))
    row = F.explode(F.array(*(F.struct(F.lit(t).alias("level"), F.col(f"_{i}").alias("n")) for i, t in enumerate(levels))))
    return counts.select("seg_id", "_n", row.alias("r")).select("seg_id", "r.level", "r.n", (F.col("r.n") / F.col("_n") * 100).alias("pct"))


def density(prob: DataFrame, level: float = 0.5) -> DataFrame:
    """Share of pixels at or above the level by row and by column: axis, seg_id, at, density."""
    g = prob.groupingSets([["seg_id", "y"], ["seg_id", "x"]], "seg_id", "y", "x").agg(F.avg((F.col("p") >= level).cast("int")).alias("density"))
    return g.select(F.when(F.col("x").isNull(), "row").otherwise("column").alias("axis"), "seg_id", F.coalesce("y", "x").alias("at"), "density")


def ink_coverage(prob: DataFrame, level: float) -> DataFrame:
    return prob.groupBy("seg_id").agg((F.avg((F.col("p") > level).cast("int")) * 100).alias("pct"))


def diff_stats(old: DataFrame, new: DataFrame, step: float = 0.05) -> DataFrame:
    """How a map changed: mean and largest absolute difference, root mean square, and shares that rose, fell and stayed."""
    both = old.select("seg_id", "y", "x", F.col("p").alias("_old")).join(new.select("seg_id", "y", "x", F.col("p").alias("_new")), ["seg_id", "y", "x"])
    d = F.col("_new") - F.col("_old")
    pct = lambda c: F.avg(c.cast("int")) * 100
    return both.groupBy("seg_id").agg(
        F.avg(F.abs(d)).alias("mean_abs_diff"), F.max(F.abs(d)).alias("max_abs_diff"), F.sqrt(F.avg(d * d)).alias("rms_diff"),
        pct(d > step).alias("pixels_increased_pct"), pct(d < -step).alias("pixels_decreased_pct"), pct(F.abs(d) <= step).alias("pixels_unchanged_pct"),
    )


def row_profile(prob: DataFrame, level: float) -> DataFrame:
    """Ink pixels of each row."""
    return prob.groupBy("seg_id", "y").agg(F.sum((F.col("p") > level).cast("int")).alias("ink"))


def collapse_layers(vox: DataFrame) -> DataFrame:
    """Mean, maximum and deviation over the layers of each pixel."""
    return vox.groupBy("seg_id", "y", "x").agg(F.avg("v").alias("mean"), F.max("v").alias("top"), F.stddev_pop("v").alias("std"))


def blend(original: DataFrame, updated: DataFrame, alpha: float) -> DataFrame:
    """alpha * updated + (1 - alpha) * original, alpha within [0, 0.5]."""
    a = min(max(float(alpha), 0.0), 0.5)
    both = original.select("seg_id", "y", "x", F.col("p").alias("_o")).join(updated.select("seg_id", "y", "x", F.col("p").alias("_u")), ["seg_id", "y", "x"])
    return both.select("seg_id", "y", "x", clip(F.lit(a) * F.col("_u") + F.lit(1.0 - a) * F.col("_o")).alias("p"))


def tinted(grey: Column, prob: Column, red: float = 0.65, other: float = 0.30) -> dict[str, Column]:
    """Red, green and blue of a grey value under a probability's tint."""
    return {"red": clip(grey + prob * red), "green": clip(grey - prob * other), "blue": clip(grey - prob * other)}


def cross_section(vox: DataFrame, *, y: int | None = None, x: int | None = None) -> DataFrame:
    """The XZ plane at a row, or the YZ plane at a column."""
    return vox.where(F.col("y") == y).select("seg_id", "z", "x", "v") if y is not None else vox.where(F.col("x") == x).select("seg_id", "z", "y", "v")


def middle_valid_row(vox: DataFrame) -> DataFrame:
    """Of each segment, the middle one of the rows that have a value above 0."""
    rows = vox.where("v > 0").groupBy("seg_id").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    return rows.select("seg_id", F.element_at("ys", (F.floor(F.size("ys") / 2) + 1).cast("int")).alias("y"))


def candidate_tiers(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("tier", tier(F.col("mean_prob")))


def tier_breakdown(candidates: DataFrame) -> DataFrame:
    """Candidates of each tier and their share; the total is a sum over the three rows."""
    by = candidate_tiers(candidates).groupBy("tier").agg(F.count("*").alias("n"))
    return by.select("tier", "n", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))) * 100).alias("pct"))
