"""Template matching of square patches: distance transforms, moments, scores and the best letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph
from .block_stencil import distances

#: The alphabet, its older forms, expected holes of each letter, and template sizes and styles.
ALPHABET = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
OLD_FORMS = {"Σ": "Ϲ"}
LETTER_HOLES = {
    "Α": 1, "Β": 2, "Γ": 0, "Δ": 1, "Ε": 0, "Ζ": 0, "Η": 0, "Θ": 1, "Ι": 0, "Κ": 0, "Λ": 0, "Μ": 0,
    "Ν": 0, "Ξ": 0, "Ο": 1, "Π": 0, "Ρ": 1, "Σ": 0, "Τ": 0, "Υ": 0, "Φ": 2, "Χ": 0, "Ψ": 0, "Ω": 1,
}
TEMPLATE_SIZES = (32, 48, 64)
TEMPLATE_STYLES = ("serif", "uncial", "skeleton")
MAX_TEMPLATES = 4096


def distance_transform(patches: DataFrame, column: str, side: int, out: str = "dt") -> DataFrame:
    """Euclidean distance from each cell to the nearest ink (value above 0.5) of its patch; 0 everywhere without ink. The work and
    the memory are linear in the cells."""

    @F.pandas_udf("array<double>")
    def transform(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in batches:
            rows: list[np.ndarray] = []
            for i in range(0, len(col), 256):
                ink = np.stack([np.asarray(v, np.float64) for v in col.iloc[i : i + 256]]) > 0.5
                rows += list(distances(ink.reshape(-1, side, side)).reshape(len(ink), -1))
            yield pd.Series(rows, dtype=object)

    return patches.withColumn(out, transform(F.col(column)))


HU_POWERS = [(p, q) for p in range(4) for q in range(4) if p + q <= 3]


def central_moments(c: dict) -> dict:
    """Moments about the centre, scaled by size, from sums of powers {(p, q): ...}; columns or arrays."""
    cy, cx = c[1, 0] / c[0, 0], c[0, 1] / c[0, 0]
    mu = {
        (2, 0): c[2, 0] - cy * c[1, 0], (0, 2): c[0, 2] - cx * c[0, 1], (1, 1): c[1, 1] - cx * c[1, 0],
        (3, 0): c[3, 0] - 3 * cy * c[2, 0] + 2 * cy * cy * c[1, 0], (0, 3): c[0, 3] - 3 * cx * c[0, 2] + 2 * cx * cx * c[0, 1],
        (2, 1): c[2, 1] - 2 * cy * c[1, 1] - cx * c[2, 0] + 2 * cy * cy * c[0, 1], (1, 2): c[1, 2] - 2 * cx * c[1, 1] - cy * c[0, 2] + 2 * cx * cx * c[1, 0],
    }
    return {(p, q): v / c[0, 0] ** (1 + (p + q) / 2) for (p, q), v in mu.items()}


def hu_invariants(e: dict) -> list:
    """The seven invariants of scaled central moments; columns or arrays."""
    a, b = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3]
    d, f = e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3]
    s = e[2, 0] - e[0, 2]
    return [
        e[2, 0] + e[0, 2], s * s + 4 * e[1, 1] * e[1, 1], d * d + f * f, a * a + b * b,
        d * a * (a * a - 3 * b * b) + f * b * (3 * a * a - b * b), s * (a * a - b * b) + 4 * e[1, 1] * a * b,
        f * a * (a * a - 3 * b * b) - d * b * (3 * a * a - b * b),
    ]


def hu_moments(cells: DataFrame, by: list[str]) -> DataFrame:
    """Seven signed-log Hu moments of the ink cells (y, x) of each group, from sums of powers."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    m = cells.groupBy(*by).agg(*(F.sum(F.pow(y, F.lit(p)) * F.pow(x, F.lit(q))).alias(f"m{p}{q}") for p, q in HU_POWERS))
    moments = central_moments({k: F.col(f"m{k[0]}{k[1]}") for k in HU_POWERS})
    eta = m.select(*by, *(v.alias(f"e{p}{q}") for (p, q), v in moments.items()))
    hu = hu_invariants({k: F.col(f"e{k[0]}{k[1]}") for k in moments})
    return eta.select(*by, *((-F.signum(h) * F.log10(F.abs(h) + 1e-15)).alias(f"hu{i + 1}") for i, h in enumerate(hu)))


def patch_cells(patches: DataFrame, key: str, column: str, side: int) -> DataFrame:
    """The ink cells of patches: key, y, x."""
    c = patches.select(key, F.posexplode(column).alias("at", "v")).where("v > 0.5")
    return c.select(key, F.floor(F.col("at") / side).cast("int").alias("y"), (F.col("at") % side).alias("x"))


def with_bank(patches: DataFrame, bank: DataFrame) -> DataFrame:
    """Every patch with every template. A bank holds a few sizes and styles of an alphabet; its size is checked before it
    is sent to all executors."""
    if bank.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES:
        raise ValueError(f"a template bank has {MAX_TEMPLATES} templates at most")
    return patches.crossJoin(F.broadcast(bank))


def best_letters(scored: DataFrame, key: str, letter: str, score: str, k: int, order: Column | None = None) -> DataFrame:
    """The best template of each letter (the first in `order` of equals), then the k best letters of each patch."""
    tie = F.lit(0) if order is None else order
    best = scored.groupBy(key, letter).agg(F.max_by(F.struct(*[c for c in scored.columns if c not in (key, letter)]), F.struct(F.col(score), -tie)).alias("b")).select(key, letter, "b.*")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), letter))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def with_expected(bank: DataFrame, expected: DataFrame) -> DataFrame:
    """The bank with the holes that each letter should have, from (letter, expected); 0 where a letter has no row."""
    dims = expected.select(F.col("letter").alias("_letter"), "expected")
    return bank.join(dims, F.col("letter") == F.col("_letter"), "left").drop("_letter").withColumn("expected", F.coalesce("expected", F.lit(0)))


def match_letters(patches: DataFrame, bank: DataFrame, side: int, k: int = 5) -> DataFrame:
    """The ensemble matcher. patches: (id, cand, cand_dt, cand_hu, holes); bank: (ord, letter, tpl, tpl_dt, tpl_hu, expected).

    Returns id, letter, rank, score and its parts."""
    both = with_bank(patches, bank)
    parts = both.select("id", "letter", "ord", "holes", "expected", S.chamfer(F.col("cand"), F.col("tpl"), F.col("cand_dt"), F.col("tpl_dt"), side).alias("chamfer"), S.ncc(F.col("cand"), F.col("tpl")).alias("ncc"), S.iou(F.col("cand"), F.col("tpl")).alias("iou"), S.hu_distance(F.col("cand_hu"), F.col("tpl_hu")).alias("hu_dist"))
    scored = parts.withColumn("score", S.ensemble(F.col("chamfer"), F.col("ncc"), F.col("iou"), F.col("hu_dist"), F.col("holes"), F.col("expected")))
    return best_letters(scored, "id", "letter", "score", k, F.col("ord"))


def candidate_patches(candidates: DataFrame, labelled: DataFrame, size: int) -> DataFrame:
    """(seg_id, id, cand): each candidate's own pixels, cut at its box and fitted to a square."""

    @F.pandas_udf("array<double>")
    def cut(cells: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        rows = []
        for at, a, b in zip(cells, h, w, strict=True):
            img = np.zeros(int(a) * int(b))
            img[np.asarray(at, np.int64)] = 1
            rows.append(fitted(img.reshape(int(a), int(b)), size).reshape(size * size))
        return pd.Series(rows)

    box = candidates.select("seg_id", F.col("id").alias("label"), "y0", "x0", "h", "w")
    at = (F.col("y") - F.col("y0")) * F.col("w") + F.col("x") - F.col("x0")
    g = labelled.join(box, ["seg_id", "label"]).groupBy("seg_id", "label").agg(F.collect_list(at.cast("int")).alias("cells"), F.first("h").alias("h"), F.first("w").alias("w"))
    return g.select("seg_id", F.col("label").alias("id"), cut("cells", "h", "w").alias("cand"))


def described(patches: DataFrame, key: str, column: str, side: int) -> DataFrame:
    """Adds what the matcher compares: `column`_dt, `column`_hu and holes, the holes of the patch as a whole, 1 less its Euler number
    (so 1 for a patch without ink)."""
    cells = patch_cells(patches, key, column, side)
    hu = hu_moments(cells, [key]).select(F.col(key).alias("_hu_key"), F.array(*(f"hu{i}" for i in range(1, 8))).alias("_hu"))
    holes = graph.hole_counts(cells.select(F.lit("").alias("seg_id"), F.col(key).alias("label"), "y", "x")).select(F.col("label").alias("_hole_key"), F.col("holes").alias("_holes"))
    d = distance_transform(patches, column, side, f"{column}_dt")
    d = d.join(hu, F.col(key) == F.col("_hu_key"), "left").join(holes, F.col(key) == F.col("_hole_key"), "left")
    return d.select(*patches.columns, f"{column}_dt", F.coalesce("_hu", F.array(*[F.lit(0.0)] * 7)).alias(f"{column}_hu"), F.coalesce(F.col("_holes").cast("int"), F.lit(1)).alias("holes"))


def simple_scores(patches: DataFrame, bank: DataFrame) -> DataFrame:
    """The single-style score: mean of the correlation and the overlap."""
    both = with_bank(patches, bank)
    return both.select("id", "letter", (0.5 * S.ncc_raw(F.col("cand"), F.col("tpl")) + 0.5 * S.iou(F.col("cand"), F.col("tpl"), 1e-6)).alias("score"))


def softmax_top(scored: DataFrame, key: str, letter: str, score: str, k: int = 5, temperature: float = 10.0) -> DataFrame:
    """Probabilities over the k best letters of each patch."""
    w = W.partitionBy(key)
    top = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), letter))).where(F.col("rank") <= k)
    e = F.exp(temperature * (F.col(score) - F.max(score).over(w)))
    top = top.withColumn("_e", e)
    return top.select(key, letter, "rank", (F.col("_e") / (F.sum("_e").over(w) + S.SOFTMAX_EPS)).alias("prob"))


def letter_table(spark) -> DataFrame:
    """The alphabet as a relation: ord, letter, form, holes. Rendered templates of a font are an asset joined to it."""
    return spark.createDataFrame([(i, c, OLD_FORMS.get(c, c), LETTER_HOLES[c]) for i, c in enumerate(ALPHABET)], "ord int, letter string, form string, holes int")


# -- patches as arrays, one at a time -------------------------------------------------------------------------------


def zoomed(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resize with the corners kept in place, then cut at one half."""
    y = np.linspace(0, img.shape[0] - 1, h) if h > 1 else np.zeros(1)
    x = np.linspace(0, img.shape[1] - 1, w) if w > 1 else np.zeros(1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    v = img[y0][:, x0] * (1 - fy) * (1 - fx) + img[y0][:, x1] * (1 - fy) * fx + img[y1][:, x0] * fy * (1 - fx) + img[y1][:, x1] * fy * fx
    return (v > 0.5).astype(np.float64)


def fitted(img: np.ndarray, size: int, *, margin: int | None = None, truncate: bool = False) -> np.ndarray:
    """A patch resized to fit a square with a margin, its aspect kept, centred. truncate: cut the shorter side's length
    to a whole number instead of rounding it (halves to even)."""
    out = np.zeros((size, size))
    h, w = img.shape
    if not h or not w:
        return out
    room = size - 2 * (max(4, size // 10) if margin is None else margin)
    short = (lambda v: int(v)) if truncate else round
    nh, nw = (room, max(1, short(w * room / h))) if h >= w else (max(1, short(h * room / w)), room)
    y, x = (size - nh) // 2, (size - nw) // 2
    out[y : y + nh, x : x + nw] = zoomed(img, nh, nw)
    return out


def centre_crop(img: np.ndarray, size: int) -> np.ndarray:
    """Cut or padded to a square, the content kept in the middle."""
    out = np.zeros((size, size), img.dtype)
    h, w = img.shape
    top, left, cut_y, cut_x = (max(0, v // 2) for v in (size - h, size - w, h - size, w - size))
    part = img[cut_y : cut_y + size, cut_x : cut_x + size]
    out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


def skeleton(img: np.ndarray) -> np.ndarray:
    """Thinning to lines one pixel wide, in two alternating passes until nothing changes."""
    a = np.pad(img > 0, 1).astype(np.uint8)
    while True:
        before = a.copy()
        for half in (0, 1):
            ring = [np.roll(a, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(r.astype(int) for r in ring)
            turns = sum((ring[i] == 0) & (ring[(i + 1) % 8] == 1) for i in range(8))
            n, e, s, w = ring[0], ring[2], ring[4], ring[6]
            ends = (n * e * s == 0) & (e * s * w == 0) if half == 0 else (n * e * w == 0) & (n * s * w == 0)
            a[(a == 1) & (count >= 2) & (count <= 6) & (turns == 1) & ends] = 0
        if (a == before).all():
            return a[1:-1, 1:-1].astype(np.float64)


def stroke_normalised(img: np.ndarray) -> np.ndarray:
    """Skeleton widened by a cross; patches of fewer than five ink pixels stay."""
    if (img > 0.5).sum() < 5:
        return img
    a = np.pad(skeleton(img > 0.5) > 0, 1)
    return (a | np.roll(a, 1, 0) | np.roll(a, -1, 0) | np.roll(a, 1, 1) | np.roll(a, -1, 1))[1:-1, 1:-1].astype(np.float64)


def patch_udf(fn, size: int):
    """A column function that applies `fn` (image to square image) to patches given as (values, height, width)."""

    @F.pandas_udf("array<double>")
    def apply(values: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([fn(np.asarray(v, np.float64).reshape(int(a), int(b))).reshape(size * size) for v, a, b in zip(values, h, w, strict=True)])

    return apply
