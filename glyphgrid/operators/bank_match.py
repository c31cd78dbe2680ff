"""Matching of patches with a bank of many sizes and styles, in one pass without a shuffle.

The bank is bounded, so that every task holds it. Sums over cells for all pairs of a batch's patches and a size's templates are matrix
products: distances one way and the other, and overlap; correlation follows from the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import match
from .block_stencil import distances

#: The style that is compared with the stroke-normalised patch.
THIN_STYLE = "skeleton"
MAX_BANK_BYTES = 64 << 20
BATCH = 64
_PARTS = ("score", "chamfer", "ncc", "iou", "hu_dist")


def hu_arrays(stack: np.ndarray) -> np.ndarray:
    """Seven signed-log Hu moments of each image's ink, 0 where it has none."""
    n, h, w = stack.shape
    y, x = np.divmod(np.arange(h * w, dtype=np.float64), w)
    sums = stack.reshape(n, -1) @ np.stack([y**p * x**q for p, q in match.HU_POWERS], axis=1)
    some = sums[:, 0] > 0
    c = {k: np.where(some, sums[:, i], 1.0) for i, k in enumerate(match.HU_POWERS)}
    hu = np.stack(match.hu_invariants(match.central_moments(c)), axis=1)
    return np.where(some[:, None], -np.sign(hu) * np.log10(np.abs(hu) + 1e-15), 0.0)


def hole_arrays(stack: np.ndarray) -> np.ndarray:
    """Holes of each image as a whole, 4-connected, from its Euler number."""
    a = stack > 0.5
    count = lambda m: m.sum(axis=(1, 2), dtype=np.int64)
    wide, high = a[:, :, 1:] & a[:, :, :-1], a[:, 1:] & a[:, :-1]
    return np.maximum(0, 1 - (count(a) - count(wide) - count(high) + count(wide[:, 1:] & wide[:, :-1])))


def _described(stack: np.ndarray) -> dict[str, np.ndarray]:
    flat = stack.reshape(len(stack), -1)
    return {"ink": flat, "dt": distances(stack > 0.5).reshape(flat.shape), "n": flat.sum(axis=1), "hu": hu_arrays(stack), "holes": hole_arrays(stack)}


def pair_scores(c: dict[str, np.ndarray], t: dict[str, np.ndarray], expected: np.ndarray, side: int) -> dict[str, np.ndarray]:
    """(patch, template) arrays of the ensemble's score and its parts, as the column functions of `scalars` state them."""
    cells, nc, nt = side * side, c["n"][:, None], t["n"][None]
    both = c["ink"] @ t["ink"].T
    empty = (nc == 0) | (nt == 0)
    far = (c["ink"] @ t["dt"].T / np.maximum(nc, 1) + c["dt"] @ t["ink"].T / np.maximum(nt, 1)) / (side * S.DIAGONAL) * 0.5
    chamfer = np.where(empty, 1.0, far)
    spread = (nc - nc * nc / cells) * (nt - nt * nt / cells)
    ncc = (both - nc * nt / cells) / (np.sqrt(np.maximum(spread, 0.0)) + S.NCC_EPS) * 0.5 + 0.5
    iou = both / (nc + nt - both + S.IOU_EPS)
    hu = np.abs(c["hu"][:, None] - t["hu"][None]).mean(axis=2)
    w = S.ENSEMBLE
    near, hu_near = np.maximum(0.0, 1 - np.minimum(chamfer, 0.5) * 2), np.maximum(0.0, 1 - np.minimum(hu, 3.0) / 3)
    bonus = np.where(np.abs(c["holes"][:, None] - expected[None]) <= 1, S.TOPOLOGY_BONUS, 0.0)
    score = w["chamfer"] * near + w["ncc"] * ncc + w["iou"] * iou + (1 - w["chamfer"] - w["ncc"] - w["iou"]) * hu_near + bonus
    return {"score": score, "chamfer": chamfer, "ncc": ncc, "iou": iou, "hu_dist": hu}


def match_patches(patches: DataFrame, bank: DataFrame, k: int = 5) -> DataFrame:
    """The k best letters of each patch, by the best template of each letter.

    patches: (id long, cand array of 0 and 1 in row order, h, w); bank: (ord, letter, style, size, tpl, expected). A patch is fitted to
    every size, as it is and stroke-normalised; of equal scores the lower ord wins, then the letter's order. Returns id, letter,
    rank, the parts of the score, size and style. Patches that are null or whose length isn't h * w have no rows; repeated ids are matched
    row by row; a patch without ink is as far as can be from all. An empty bank gives no rows."""
    held = bank.select("ord", "letter", "style", "size", "tpl", "expected")
    measure = held.agg(F.count("*").alias("n"), F.sum(8 * F.size("tpl")).alias("bytes")).first()
    if measure["n"] > match.MAX_TEMPLATES or (measure["bytes"] or 0) > MAX_BANK_BYTES:
        raise ValueError(f"a template bank has {match.MAX_TEMPLATES} templates and {MAX_BANK_BYTES} bytes at most")
    rows = sorted(held.collect(), key=lambda r: r["ord"])
    letters = sorted({r["letter"] for r in rows})
    groups = []
    for size, thin in sorted({(r["size"], r["style"] == THIN_STYLE) for r in rows}):
        of = [r for r in rows if (r["size"], r["style"] == THIN_STYLE) == (size, thin)]
        groups.append((size, thin, [r["ord"] for r in of], np.packbits(np.array([r["tpl"] for r in of]) > 0.5, axis=1), np.array([r["expected"] for r in of])))
    names = {r["ord"]: (letters.index(r["letter"]), r["size"], r["style"]) for r in rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [_described(np.unpackbits(bits, axis=1, count=size * size).reshape(-1, size, size).astype(np.float64)) for size, _, _, bits, _ in groups]
        order = np.array([o for _, _, ords, _, _ in groups for o in ords])
        letter = np.array([names[o][0] for o in order])
        for batch in batches:
            found = [r for r in batch.to_pylist() if r["cand"] is not None and len(r["cand"]) == (r["h"] or 0) * (r["w"] or 0)]
            for i in range(0, len(found) if rows else 0, BATCH):
                part = found[i : i + BATCH]
                raw = [np.asarray(r["cand"], np.float64).reshape(r["h"], r["w"]) for r in part]
                forms = {False: raw, True: [match.stroke_normalised(img) for img in raw]}
                scores = [pair_scores(_described(np.stack([match.fitted(img, size) for img in forms[thin]])), t, expected, size) for (size, thin, _, _, expected), t in zip(groups, templates, strict=True)]
                yield _best(part, {p: np.concatenate([s[p] for s in scores], axis=1) for p in _PARTS}, order, letter)

    def _best(part: list[dict], scores: dict[str, np.ndarray], order: np.ndarray, letter: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        for row, r in enumerate(part):
            s = scores["score"][row]
            first = np.lexsort((order, -s))
            _, of_letter = np.unique(letter[first], return_index=True)
            best = first[of_letter]
            best = best[np.lexsort((letter[best], -s[best]))][:k]
            out += [(r["id"], letters[letter[b]], n + 1, *(float(scores[p][row, b]) for p in _PARTS), *names[order[b]][1:]) for n, b in enumerate(best)]
        fields = [("id", pa.int64()), ("letter", pa.string()), ("rank", pa.int32()), *((p, pa.float64()) for p in _PARTS), ("size", pa.int32()), ("style", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return patches.select(F.col("id").cast("long").alias("id"), F.col("cand").cast("array<double>").alias("cand"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w")).mapInArrow(run, "id long, letter string, rank int, " + ", ".join(f"{p} double" for p in _PARTS) + ", size int, style string")
