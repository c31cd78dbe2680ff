"""Overlapping tiles: covering arithmetic instead of a range join, model inference and overlap averaging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stencil import extents


def tile_numbers(at: Column, size: Column, tile: int, stride: int, last: Column | None = None) -> Column:
    """Numbers of the tiles that cover a coordinate, or any from it to `last`; tiles reach to the end of the image at most, so a
    rest stays uncovered."""
    n = F.floor((size - tile) / stride)
    lo = F.greatest(F.lit(0), F.ceil((at - tile + 1) / stride)).cast("int")
    hi = F.least(n, F.floor((at if last is None else last) / stride)).cast("int")
    return F.when((size >= tile) & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def tile_pixels(pixels: DataFrame, tile: int, stride: int) -> DataFrame:
    """Each pixel once for each tile it lies in: adds ty and tx, the tile's corner."""
    p = pixels.join(extents(pixels), "seg_id")
    p = p.withColumn("ty", F.explode(tile_numbers(F.col("y"), F.col("h"), tile, stride)))
    p = p.withColumn("tx", F.explode(tile_numbers(F.col("x"), F.col("w"), tile, stride)))
    return p.withColumns({"ty": F.col("ty") * stride, "tx": F.col("tx") * stride}).drop("h", "w")


def admitted_tiles(tiled: DataFrame, mask: Column, least: float | None) -> DataFrame:
    """Tiles with a share of the mask of `least` or more; with None, with any of it."""
    g = tiled.groupBy("seg_id", "ty", "tx").agg(F.avg(mask.cast("int")).alias("share"))
    return g.where(F.col("share") > 0 if least is None else F.col("share") >= least)


def overlap_average(pixels: DataFrame, predicted: DataFrame, mask: Column | None = None) -> DataFrame:
    """Weighted mean of what tiles predict for each pixel; 0 where none covers it or the mask is off.

    predicted: (seg_id, y, x, p[, weight])."""
    weight = F.col("weight") if "weight" in predicted.columns else F.lit(1.0)
    got = predicted.groupBy("seg_id", "y", "x").agg((F.sum(F.col("p") * weight) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("_p"))
    out = pixels.join(got, ["seg_id", "y", "x"], "left")
    value = F.coalesce("_p", F.lit(0.0))
    return out.select("seg_id", "y", "x", (value if mask is None else F.when(mask, value).otherwise(0.0)).alias("p"))


def patch_rows(vox: DataFrame, tile: int, stride: int) -> DataFrame:
    """One row for each tile with its voxels in order z, y, x: seg_id, ty, tx, img."""
    t = tile_pixels(vox, tile, stride)
    g = t.groupBy("seg_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", "v"))).alias("cells"))
    return g.select("seg_id", "ty", "tx", F.transform("cells", lambda c: c["v"].cast("float")).alias("img"))


def predict_tiles(patches: DataFrame, load: Callable[[], Callable], tile: int) -> DataFrame:
    """Runs a model over tiles: `load` is called once in each worker and returns a function from an array (tiles, z, y, x),
    scaled to [0, 1], to probabilities (tiles, y, x). Returns (seg_id, y, x, p), one row for each tile and pixel."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        yy, xx = np.divmod(np.arange(tile * tile), tile)
        for b in batches:
            if not len(b):
                continue
            img = np.stack([np.asarray(v, np.float32) for v in b["img"]])
            p = np.asarray(model(img.reshape(len(b), -1, tile, tile) / 255.0), np.float64).reshape(len(b), -1)
            n = tile * tile
            yield pd.DataFrame({"seg_id": np.repeat(b["seg_id"].to_numpy(), n), "y": (b["ty"].to_numpy()[:, None] + yy).ravel().astype(np.int32), "x": (b["tx"].to_numpy()[:, None] + xx).ravel().astype(np.int32), "p": p.ravel()})

    return patches.mapInPandas(run, "seg_id string, y int, x int, p double")


def predict_segment(vox: DataFrame, load: Callable[[], Callable], tile: int, stride: int) -> DataFrame:
    """Sliding-window inference over a volume: tiles with any mask, overlap average, mask."""
    from .reduce import derive_mask

    mask = derive_mask(vox)
    tiles = admitted_tiles(tile_pixels(mask, tile, stride), F.col("mask"), None).select("seg_id", "ty", "tx")
    patches = patch_rows(vox, tile, stride).join(tiles, ["seg_id", "ty", "tx"], "left_semi")
    return overlap_average(mask, predict_tiles(patches, load, tile), F.col("mask"))


def padded(pixels: DataFrame, size: int) -> DataFrame:
    """The map with zeros below and to the right, up to whole windows."""
    e = extents(pixels).withColumns({c: (F.ceil(F.col(c) / size) * size).cast("int") for c in ("h", "w")})
    cells = e.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return cells.select("seg_id", "y", "x").join(pixels, ["seg_id", "y", "x"], "left").select("seg_id", "y", "x", F.coalesce("p", F.lit(0.0)).alias("p"))


def window_partition(pixels: DataFrame, size: int) -> DataFrame:
    """Window number and place within it of each pixel."""
    return pixels.withColumns({"wy": F.floor(F.col("y") / size).cast("int"), "wx": F.floor(F.col("x") / size).cast("int"), "iy": F.col("y") % size, "ix": F.col("x") % size})


def window_merge(pixels: DataFrame, size: int) -> DataFrame:
    """The places that pixels of windows come from."""
    return pixels.withColumns({"y": F.col("wy") * size + F.col("iy"), "x": F.col("wx") * size + F.col("ix")}).drop("wy", "wx", "iy", "ix")


def oriented(pixels: DataFrame, flip_y: bool = False, flip_x: bool = False, turns: int = 0) -> DataFrame:
    """Flips, then quarter turns against the clock, as index arithmetic."""
    y, x, h, w = F.col("y"), F.col("x"), F.col("h"), F.col("w")
    y = h - 1 - y if flip_y else y
    x = w - 1 - x if flip_x else x
    for _ in range(turns % 4):
        y, x, h, w = w - 1 - x, y, w, h
    return pixels.join(extents(pixels), "seg_id").withColumns({"y": y.cast("int"), "x": x.cast("int")}).drop("h", "w")


def orientation_average(prob: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean of the predictions over the eight orientations, each turned back."""
    every = None
    for flip in (False, True):
        for turns in range(4):
            seen = oriented(prob, flip_x=flip, turns=turns)
            back = oriented(predict(seen), turns=-turns % 4)
            back = oriented(back, flip_x=flip) if flip else back
            every = back if every is None else every.unionByName(back)
    return every.groupBy("seg_id", "y", "x").agg(F.avg("p").alias("p"))


def drawn(n: Column | int, *key: Column | str) -> Column:
    """A whole number in [0, n) that depends on the key alone."""
    text = F.md5(F.concat_ws(":", *((F.col(k) if isinstance(k, str) else k).cast("string") for k in key)).cast("binary"))
    return F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def summed_area(pixels: DataFrame, *values: str) -> DataFrame:
    """Sums of the columns over all pixels above and left of each, itself included; of a map without gaps."""
    along, down = W.partitionBy("seg_id", "y").orderBy("x"), W.partitionBy("seg_id", "x").orderBy("y")
    rows = pixels.select("seg_id", "y", "x", *(F.sum(v).over(along).alias(v) for v in values))
    return rows.select("seg_id", "y", "x", *(F.sum(v).over(down).alias(v) for v in values))


def sampled_patches(pixels: DataFrame, n: int, size: int, *, tries: int = 60, seed: int = 0, least_mask: float = 0.6, ink: float = 0.15) -> DataFrame:
    """n random patches of each segment: seg_id, sample, attempt, y, x, share (of the mask), label (its mean).

    pixels: (seg_id, y, x, mask, label), without gaps. A patch is tried at random places, `tries` of them; the first serves
    whose mask share is `least_mask` or more and, on every other coin, whose mean label is `ink` or more; without one, the
    last place. All attempts are rows, whose sums come from four corners of the summed areas, so nothing is cut out to be
    thrown away."""
    sums = summed_area(pixels.select("seg_id", "y", "x", F.col("mask").cast("double").alias("m"), F.col("label").cast("double").alias("l")), "m", "l")
    e = extents(pixels).where((F.col("h") >= size) & (F.col("w") >= size))
    a = e.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    at = lambda side, c: drawn(F.col(side) - size + 1, "seg_id", "sample", "attempt", F.lit(c), F.lit(seed)).cast("int")
    a = a.select("seg_id", "sample", "attempt", at("h", "y").alias("y"), at("w", "x").alias("x"))
    corner = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), (F.col("y") + dy).alias("cy"), (F.col("x") + dx).alias("cx")) for s, dy, dx in ((1, size - 1, size - 1), (-1, -1, size - 1), (-1, size - 1, -1), (1, -1, -1)))))
    c = a.withColumn("c", corner).select("seg_id", "sample", "attempt", "y", "x", "c.s", "c.cy", "c.cx")
    met = c.join(sums.select("seg_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "m", "l"), ["seg_id", "cy", "cx"], "left")
    area = float(size * size)
    mean = lambda v: (F.sum(F.col("s") * F.coalesce(v, F.lit(0.0))) / area)
    g = met.groupBy("seg_id", "sample", "attempt", "y", "x").agg(mean("m").alias("share"), mean("l").alias("label"))
    coin = drawn(2, "seg_id", "sample", "attempt", F.lit("coin"), F.lit(seed)) == 0
    good = (F.col("share") >= least_mask) & ((F.col("label") >= ink) | coin)
    last = F.col("attempt") == tries - 1
    row = F.struct("attempt", "y", "x", "share", "label")
    best = g.groupBy("seg_id", "sample").agg(F.coalesce(F.min(F.when(good, row)), F.max(F.when(last, row))).alias("b"))
    return best.select("seg_id", "sample", "b.*")


def sampled_tiles(tiled: DataFrame, n: int, *, mask: Column, label: Column, seed: int = 0, least_mask: float = 0.6, ink: float = 0.15) -> DataFrame:
    """n tiles of each segment in a fixed random order: mask share of `least_mask` or more; half of those with a mean label
    below `ink` are left out by a coin that depends on the tile."""
    g = tiled.groupBy("seg_id", "ty", "tx").agg(F.avg(mask.cast("int")).alias("share"), F.avg(label).alias("label"))
    coin = drawn(2, "seg_id", "ty", "tx", F.lit(seed + 1)) == 0
    g = g.where((F.col("share") >= least_mask) & ((F.col("label") >= ink) | coin))
    rank = F.row_number().over(W.partitionBy("seg_id").orderBy(drawn(1 << 32, "seg_id", "ty", "tx", F.lit(seed)), "ty", "tx"))
    return g.withColumn("rank", rank).where(F.col("rank") <= n)
