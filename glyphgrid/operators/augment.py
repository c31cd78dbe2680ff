"""Random changes of training patches, fixed by a seed, and pooling over layers.

Pixel-wise ones are column expressions whose randomness is a hash of the key, so that a task that is run again gives the
same; those that move pixels work on whole patches in pandas functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the hash of the key."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)


def normal(seed: int, *key: Column) -> Column:
    """A standard normal number from the hash of the key, by two uniform ones."""
    a, b = uniform(seed, *key), uniform(seed + 1, *key)
    return F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(2.0 * F.lit(np.pi) * b)


def noisy(vox: DataFrame, by: list[str], *, sigma: float = 0.02, brightness: float = 0.1, drop: float = 0.1, seed: int = 0) -> DataFrame:
    """v in [0, 1] with noise for each voxel, one brightness for each patch, and whole layers set to 0. by: the patch."""
    patch, at = [F.col(c) for c in by], [F.col(c) for c in ("z", "y", "x")]
    gain = 1.0 + (uniform(seed + 2, *patch) * 2 - 1) * brightness
    kept = uniform(seed + 3, *patch, F.col("z")) >= drop
    v = clip(F.col("v") * gain + normal(seed, *patch, *at) * sigma)
    return vox.withColumn("v", F.when(kept, v).otherwise(0.0))


def shifted_layers(vox: DataFrame, by: list[str], most: int, seed: int = 0) -> DataFrame:
    """Each patch moved along z by a number of layers in [-most, most]; layers that come in are 0."""
    return moved_layers(vox, by, F.floor(uniform(seed, *(F.col(c) for c in by)) * (2 * most + 1)).cast("int") - most)


def moved_layers(vox: DataFrame, by: list[str], step: Column) -> DataFrame:
    """Each patch moved along z by `step` layers; layers that come in are 0."""
    moved = vox.withColumn("z", F.col("z") + step).select(*by, "z", "y", "x", F.col("v").alias("_v"))
    out = vox.select(*by, "z", "y", "x").join(moved, [*by, "z", "y", "x"], "left")
    return out.select(*by, "z", "y", "x", F.coalesce("_v", F.lit(0.0)).alias("v"))


def smooth_field(rng: np.random.Generator, h: int, w: int, cell: int) -> np.ndarray:
    """Random numbers on a coarse grid, interpolated between."""
    coarse = rng.uniform(-1, 1, (h // cell + 2, w // cell + 2))
    y, x = np.arange(h) / cell, np.arange(w) / cell
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return coarse[y0][:, x0] * (1 - fy) * (1 - fx) + coarse[y0][:, x0 + 1] * (1 - fy) * fx + coarse[y0 + 1][:, x0] * fy * (1 - fx) + coarse[y0 + 1][:, x0 + 1] * fy * fx


def sampled(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at fractional places, bilinear; places outside take the border's."""
    h, w = img.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return img[y0, x0] * (1 - fy) * (1 - fx) + img[y0, x1] * (1 - fy) * fx + img[y1, x0] * fy * (1 - fx) + img[y1, x1] * fy * fx


def elastic(img: np.ndarray, seed: int, strength: float = 3.0, cell: int = 16) -> np.ndarray:
    """A patch bent by a smooth random field."""
    rng = np.random.default_rng(seed)
    y, x = np.indices(img.shape).astype(float)
    return sampled(img, y + strength * smooth_field(rng, *img.shape, cell), x + strength * smooth_field(rng, *img.shape, cell))


def moved(img: np.ndarray, seed: int, shift: float = 0.1, scale: float = 0.15, degrees: float = 30.0) -> np.ndarray:
    """A patch shifted, scaled and turned about its middle."""
    rng = np.random.default_rng(seed)
    h, w = img.shape
    a, s = np.deg2rad(rng.uniform(-degrees, degrees)), 1 + rng.uniform(-scale, scale)
    dy, dx = rng.uniform(-shift, shift) * h, rng.uniform(-shift, shift) * w
    y, x = np.indices(img.shape).astype(float)
    y, x = y - (h - 1) / 2 - dy, x - (w - 1) / 2 - dx
    return sampled(img, (np.cos(a) * y - np.sin(a) * x) / s + (h - 1) / 2, (np.sin(a) * y + np.cos(a) * x) / s + (w - 1) / 2)


def blurred(img: np.ndarray, radius: int = 1) -> np.ndarray:
    """Box blur, mirrored at the borders."""
    p = np.pad(img, radius, mode="symmetric")
    n = 2 * radius + 1
    return sum(p[i : i + img.shape[0], j : j + img.shape[1]] for i in range(n) for j in range(n)) / (n * n)


def holes(img: np.ndarray, seed: int, count: int = 4, share: float = 0.2) -> np.ndarray:
    """Rectangles set to 0."""
    rng = np.random.default_rng(seed)
    out = img.copy()
    h, w = max(1, int(img.shape[0] * share)), max(1, int(img.shape[1] * share))
    for _ in range(count):
        y, x = rng.integers(0, img.shape[0]), rng.integers(0, img.shape[1])
        out[y : y + h, x : x + w] = 0
    return out


def patch_change(change, *more):
    """A column function (values, height, width, seed) that applies changes of an image in turn, each with the seed."""

    @F.pandas_udf("array<double>")
    def apply(values: pd.Series, h: pd.Series, w: pd.Series, seed: pd.Series) -> pd.Series:
        out = []
        for v, a, b, s in zip(values, h, w, seed, strict=True):
            img = np.asarray(v, np.float64).reshape(int(a), int(b))
            for k, f in enumerate((change, *more)):
                img = f(img, int(s) + k)
            out.append(img.ravel())
        return pd.Series(out)

    return apply


def attention_pool(vox: DataFrame, score: Column, temperature: float = 1.0) -> DataFrame:
    """Mean over the layers of each pixel, weighted by the softmax of a score."""
    s = vox.withColumn("_s", score * temperature)
    top = s.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(W.partitionBy("seg_id", "y", "x"))))
    return top.groupBy("seg_id", "y", "x").agg((F.sum(F.col("_e") * F.col("v")) / F.sum("_e")).alias("p"))


def running_mean(history: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """The mean so far, as a training loop reports it."""
    return history.withColumn("running_mean", F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
