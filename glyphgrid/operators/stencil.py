"""Neighbourhood operators on maps.

A pixel is sent to the places whose neighbourhood it is part of (`explode` over a constant list of offsets), or a box is
summed along one axis and then the other by window frames over rows of an image: both shuffle on pixel or line keys
and hold no image in a task. Borders are mirrored as d c b a | a b c d where values are averaged or ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIXEL = ["seg_id", "y", "x"]


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets of a digital disk: 5 for radius 1, 13 for radius 2."""
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if dy * dy + dx * dx <= radius * radius]


def extents(pixels: DataFrame) -> DataFrame:
    """Height and width of each segment."""
    return pixels.groupBy("seg_id").agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))


def offsets(of: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in of)))


def _mirrored(at: Column, size: Column) -> Column:
    """Places along one axis at which a pixel also stands when the image is mirrored beyond its borders."""
    return F.array(at, -1 - at, 2 * size - 1 - at)


def median_filter(prob: DataFrame, radius: int = 1) -> DataFrame:
    """Median of the (2 r + 1)-square around each pixel."""
    ext = extents(prob)
    r = range(-radius, radius + 1)
    p = prob.select(*PIXEL, "p").join(ext, "seg_id")
    p = p.withColumn("y", F.explode(F.array_distinct(_mirrored(F.col("y"), F.col("h"))))).withColumn("x", F.explode(F.array_distinct(_mirrored(F.col("x"), F.col("w")))))
    near = (F.col("y") >= -radius) & (F.col("y") < F.col("h") + radius) & (F.col("x") >= -radius) & (F.col("x") < F.col("w") + radius)
    p = p.where(near).withColumn("o", offsets([(dy, dx) for dy in r for dx in r])).withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx")})
    p = p.where((F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < F.col("w")))
    return p.groupBy(*PIXEL).agg(F.median("p").alias("p"))


def box_mean(prob: DataFrame, size: int) -> DataFrame:
    """Mean of the size-square around each pixel of complete images, along y and then along x."""
    before, after = size // 2, size - 1 - size // 2
    ext = extents(prob)
    out = prob.select(*PIXEL, "p").join(ext, "seg_id")
    for axis, other, length in (("y", "x", "h"), ("x", "y", "w")):
        a, n = F.col(axis), F.col(length)
        wide = out.withColumn(axis, F.explode(F.array_distinct(_mirrored(a, n)))).where((a >= -before) & (a < n + after))
        w = W.partitionBy("seg_id", other).orderBy(axis).rowsBetween(-before, after)
        out = wide.withColumn("p", F.avg("p").over(w)).where((a >= 0) & (a < n))
    return out.select(*PIXEL, "p")


def adaptive_threshold(prob: DataFrame, window: int = 31, offset: float = 0.05) -> DataFrame:
    """1 where a pixel exceeds the mean around it by more than `offset`."""
    mean = box_mean(prob, window).withColumnRenamed("p", "_mean")
    return prob.join(mean, PIXEL).select(*PIXEL, (F.col("p") > F.col("_mean") + offset).cast("double").alias("p"))


def dilate(ink: DataFrame, ext: DataFrame, radius: int) -> DataFrame:
    """Ink grown by a disk, inside the image."""
    o = ink.select(*PIXEL).withColumn("o", offsets(disk(radius))).select("seg_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    return o.join(ext, "seg_id").where("y >= 0 and y < h and x >= 0 and x < w").select(*PIXEL)


def erode(ink: DataFrame, ext: DataFrame, radius: int) -> DataFrame:
    """Pixels whose whole disk, as far as it lies inside the image, is ink."""
    of = disk(radius)
    hits = ink.select(*PIXEL).withColumn("o", offsets(of)).select("seg_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).groupBy(*PIXEL).agg(F.count("*").alias("n"))
    inside = F.lit(0)
    for dy, dx in of:
        y, x = F.col("y") + dy, F.col("x") + dx
        inside = inside + ((y >= 0) & (y < F.col("h")) & (x >= 0) & (x < F.col("w"))).cast("int")
    return hits.join(ext, "seg_id").where("y >= 0 and y < h and x >= 0 and x < w").where(F.col("n") == inside).select(*PIXEL)


def closing(ink: DataFrame, ext: DataFrame, radius: int = 2) -> DataFrame:
    return erode(dilate(ink, ext, radius), ext, radius)


def opening(ink: DataFrame, ext: DataFrame, radius: int = 1) -> DataFrame:
    return dilate(erode(ink, ext, radius), ext, radius)


def masked(prob: DataFrame, keep: DataFrame) -> DataFrame:
    """Values outside the pixel set become 0."""
    k = keep.select(*PIXEL, F.lit(True).alias("_keep"))
    return prob.join(k, PIXEL, "left").select(*PIXEL, F.when(F.col("_keep"), F.col("p")).otherwise(0.0).alias("p"))


def equalised(prob: DataFrame, *, tile: int = 8, bins: int = 256, clip_limit: float = 0.02) -> DataFrame:
    """Contrast-limited adaptive equalisation: a clipped histogram for each tile, its running total as a mapping, and for
    each pixel the bilinear mean of the mappings of the four nearest tiles."""
    ext = extents(prob)
    span = prob.groupBy("seg_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    base = prob.join(ext, "seg_id").join(span, "seg_id")
    level = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    base = base.withColumn("bin", level).withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    counts = base.groupBy("seg_id", "ty", "tx", "bin").agg(F.count("*").alias("n"))
    every = W.partitionBy("seg_id", "ty", "tx")
    total = F.sum("n").over(every)
    limit = F.greatest(F.lit(1.0), clip_limit * total)
    cut = counts.withColumns({"total": total, "kept": F.least(F.col("n").cast("double"), limit)})
    # what is clipped is spread evenly over all bins
    cut = cut.withColumn("spread", (F.col("total") - F.sum("kept").over(every)) / bins)
    upto = F.sum("kept").over(every.orderBy("bin")) + F.col("spread") * (F.col("bin") + 1)
    steps = cut.select("seg_id", "ty", "tx", "bin", (upto / F.col("total")).alias("cdf"), (F.col("spread") / F.col("total")).alias("slope"))
    table = steps.groupBy("seg_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("bin", "cdf", "slope"))).alias("steps"))
    fy, fx = (F.col("y") + 0.5) / tile - 0.5, (F.col("x") + 0.5) / tile - 0.5
    rows, cols = F.ceil(F.col("h") / tile).cast("int") - 1, F.ceil(F.col("w") / tile).cast("int") - 1
    near = []
    for dy in (0, 1):
        for dx in (0, 1):
            wy = F.when(F.lit(dy) == 1, fy - F.floor(fy)).otherwise(1 - (fy - F.floor(fy)))
            wx = F.when(F.lit(dx) == 1, fx - F.floor(fx)).otherwise(1 - (fx - F.floor(fx)))
            y, x = F.least(F.greatest(F.floor(fy) + dy, F.lit(0)), rows), F.least(F.greatest(F.floor(fx) + dx, F.lit(0)), cols)
            near.append(F.struct(y.cast("int").alias("ty"), x.cast("int").alias("tx"), (wy * wx).alias("weight")))
    px = base.select(*PIXEL, "bin", F.explode(F.array(*near)).alias("t")).select(*PIXEL, "bin", "t.ty", "t.tx", "t.weight")
    got = px.join(table, ["seg_id", "ty", "tx"])
    below = F.filter("steps", lambda s: s["bin"] <= F.col("bin"))
    last = F.element_at(below, -1)
    value = F.when(F.size(below) > 0, last["cdf"] + last["slope"] * (F.col("bin") - last["bin"])).otherwise(F.element_at("steps", 1)["slope"] * (F.col("bin") + 1))
    return got.groupBy(*PIXEL).agg(F.sum(F.col("weight") * value).alias("p"))


def filtered(prob: DataFrame, *, radius: int = 1, close: int = 2, open_: int = 1, level: float = 0.40, share: float = 0.70, enhance=equalised) -> DataFrame:
    """The whole filter chain: median, equalisation, soft blend, threshold, closing, opening, mask, clip.

    enhance: the contrast step; `None` leaves it out."""
    smooth = median_filter(prob, radius) if radius > 0 else prob
    better = (enhance(smooth) if enhance else smooth).select(*PIXEL, F.col("p").alias("_e"))
    mixed = prob.join(better, PIXEL).select(*PIXEL, (share * F.col("_e") + (1 - share) * F.col("p")).alias("p"))
    ext = extents(prob)
    keep = opening(closing(mixed.where(F.col("p") > level), ext, close), ext, open_)
    return masked(mixed, keep).withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)))
