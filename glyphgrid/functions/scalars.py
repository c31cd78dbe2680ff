"""Scalar and array functions of the raster and glyph operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NCC_EPS, IOU_EPS, CLI_EPS, SOFTMAX_EPS = 1e-8, 1e-8, 1e-6, 1e-9
DIAGONAL = 1.41421
ENSEMBLE = {"chamfer": 0.40, "ncc": 0.35, "iou": 0.25}
TOPOLOGY_BONUS = 0.06


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, least: float = 0.01) -> Column:
    """Log odds of p clipped to [least, 1 - least]."""
    q = clip(p, least, 1 - least)
    return F.log(q / (1 - q))


def clip(x: Column, lo: float | int | Column = 0.0, hi: float | int | Column = 1.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(lo)), as_col(hi))


def half_even(x: Column) -> Column:
    """Rounds to whole numbers, halves to the even one."""
    return F.rint(x)


def clamp_pixel(pos: Column, size: Column | int) -> Column:
    """Nearest pixel (halves to even) inside [0, size)."""
    return clip(half_even(pos), F.lit(0.0), (size if isinstance(size, Column) else F.lit(size)) - F.lit(1.0)).cast("int")


def tier(mean_prob: Column, high: float = 0.70, medium: float = 0.45) -> Column:
    return F.when(mean_prob > high, "HIGH").when(mean_prob >= medium, "MEDIUM").otherwise("LOW")


def truncated_byte(p: Column) -> Column:
    """p * 255 cut to a whole number, as label maps are stored."""
    return (p * 255).cast("int")


def wide_to_byte(v: Column, bits: Column | int) -> Column:
    """Values of layers stored with `bits` bits as eight: those of wider layers lose their low byte, others stay."""
    wide = bits if isinstance(bits, Column) else F.lit(bits)
    return F.when(wide > 8, F.shiftright(v, 8)).otherwise(v)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def ink(a: Column) -> Column:
    """1.0 where a value is above 0."""
    return F.transform(a, lambda x: F.when(x > 0, 1.0).otherwise(0.0))


def centred(a: Column) -> Column:
    return F.transform(a, lambda x: x - array_sum(a) / F.size(a))


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation of two patches as a similarity in [0, 1]; from sums, so that each patch is read once."""
    n = F.size(a)
    sa, sb = array_sum(a), array_sum(b)
    va, vb = dot(a, a) - sa * sa / n, dot(b, b) - sb * sb / n
    return (dot(a, b) - sa * sb / n) / (F.sqrt(F.greatest(va * vb, F.lit(0.0))) + NCC_EPS) * 0.5 + 0.5


def ncc_raw(a: Column, b: Column) -> Column:
    """The same in [-1, 1], each norm widened by an epsilon."""
    n = F.size(a)
    sa, sb = array_sum(a), array_sum(b)
    norm = lambda x, s: F.sqrt(F.greatest(dot(x, x) - s * s / n, F.lit(0.0))) + CLI_EPS
    return (dot(a, b) - sa * sb / n) / (norm(a, sa) * norm(b, sb))


def iou(a: Column, b: Column, eps: float = IOU_EPS) -> Column:
    both = dot(a, b)
    return both / (array_sum(a) + array_sum(b) - both + eps)


def chamfer(cand: Column, tpl: Column, cand_dt: Column, tpl_dt: Column, side: int) -> Column:
    """Mean distance both ways between the ink of two patches over the diagonal, halved; 1 if either has none."""
    nc, nt = array_sum(cand), array_sum(tpl)
    far = (dot(cand, tpl_dt) / nc + dot(tpl, cand_dt) / nt) / (side * DIAGONAL) * 0.5
    return F.when((nc == 0) | (nt == 0), F.lit(1.0)).otherwise(far)


def hu_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def ensemble(chamfer_: Column, ncc_: Column, iou_: Column, hu: Column, holes: Column, expected: Column) -> Column:
    """Weighted similarity of a candidate and a template, with a bonus for hole counts that differ by one at most."""
    w = ENSEMBLE
    rest = 1 - w["chamfer"] - w["ncc"] - w["iou"]
    near = F.greatest(F.lit(0.0), 1 - F.least(chamfer_, F.lit(0.5)) * 2)
    hu_near = F.greatest(F.lit(0.0), 1 - F.least(hu, F.lit(3.0)) / 3)
    return w["chamfer"] * near + w["ncc"] * ncc_ + w["iou"] * iou_ + rest * hu_near + F.when(F.abs(holes - expected) <= 1, TOPOLOGY_BONUS).otherwise(0.0)


def softmax(scores: Column, temperature: float = 8.0) -> Column:
    """Probabilities of an array of scores; a larger temperature makes them more peaked."""
    e = F.transform(scores, lambda s: F.exp(temperature * (s - F.array_max(scores))))
    return F.transform(e, lambda x: x / (array_sum(e) + SOFTMAX_EPS))


def gaussian(dy: Column, dx: Column, radius: int = 12) -> Column:
    sigma = radius / 2.5
    return F.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))


def gap_missing(gap: Column, width: Column) -> Column:
    """Characters missing in a gap."""
    return F.greatest(F.lit(1), half_even(gap / width).cast("int") - 1)


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, rounded from its exact value, halves to even."""
    return F.regexp_replace(F.format_number(x.cast("double"), places), ",", "")


def learning_rate(epoch: Column, base: float = 1e-3, warmup: int = 5, epochs: int = 60) -> Column:
    """Linear warm-up, then half a cosine."""
    share = (epoch - warmup) / F.greatest(F.lit(1), F.lit(epochs - warmup))
    return F.lit(base) * F.when(epoch < warmup, (epoch + 1) / warmup).otherwise((1 + F.cos(F.lit(3.141592653589793) * share)) * 0.5)


def gigabytes(n: Column, binary: bool = False) -> Column:
    return n / (1024.0**3 if binary else 1e9)
