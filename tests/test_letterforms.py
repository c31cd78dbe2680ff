"""Rendered templates, and the matcher with a bank of several sizes and styles against the column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import bank_match as M
from glyphgrid.operators import graph, match
from glyphgrid.operators import letterforms as L


@pytest.fixture(scope="module")
def bank(spark):
    return L.bank(spark).cache()


def test_holes_are_those_of_the_table(spark, bank):
    cells = L.rendered(spark).select(F.lit("").alias("seg_id"), F.col("ord").alias("label"), "y", "x")
    holes = {r["label"]: r["holes"] for r in graph.hole_counts(cells).collect()}
    rows = bank.collect()
    assert len(rows) == len(holes) == 24 * 9 and len({(r["letter"], r["style"], r["size"]) for r in rows}) == 24 * 9
    for r in rows:
        assert holes[r["ord"]] == r["expected"] == match.LETTER_HOLES[r["letter"]], r[:4]
        assert M.hole_arrays(np.array(r["tpl"]).reshape(1, r["size"], r["size"]))[0] == r["expected"]
        assert len(r["tpl"]) == r["size"] ** 2 and not np.array(r["tpl"]).reshape(r["size"], -1)[[0, -1]].any()


def test_cells_are_those_near_a_line(spark):
    rng = np.random.default_rng(3)
    lines = [(0, 20, *map(float, rng.uniform(-3, 23, 4)), float(rng.uniform(1, 4))) for _ in range(6)] + [(1, 20, 4.0, 4.0, 4.0, 4.0, 5.0), (2, 20, 90.0, 90.0, 95.0, 99.0, 3.0)]
    got = {tuple(r) for r in L.rasterised(spark.createDataFrame(lines, "k int, size int, x0 double, y0 double, x1 double, y1 double, pen double"), ["k"]).collect()}
    want = set()
    for k, size, x0, y0, x1, y1, pen in lines:
        a, b = np.array([x0, y0]), np.array([x1, y1])
        for y in range(size):
            for x in range(size):
                p = np.array([x + 0.5, y + 0.5])
                t = np.clip((p - a) @ (b - a) / max((b - a) @ (b - a), 1e-300), 0, 1)
                if np.linalg.norm(p - a - t * (b - a)) <= pen / 2:
                    want.add((k, size, y, x))
    assert got == want and not any(k == 2 for k, *_ in got)


def test_a_template_is_its_own_best_letter(spark, bank):
    own = bank.where("style = 'uncial' AND size = 48").select(F.col("ord").alias("id"), F.col("tpl").alias("cand"), F.lit(48).alias("h"), F.lit(48).alias("w"), "letter")
    got = M.match_patches(own, bank, 1).join(own.select("id", F.col("letter").alias("drawn")), "id").collect()
    assert len(got) == 24 and sum(r["letter"] == r["drawn"] for r in got) >= 22


def test_scores_equal_those_of_columns(spark, bank):
    size, side = 32, 9
    rng = np.random.default_rng(8)
    imgs = [(i, (rng.random((side, side)) > 0.45).astype(float).ravel().tolist()) for i in range(5)] + [(9, [0.0] * side * side)]
    patches = spark.createDataFrame([(*r, side, side) for r in imgs], "id long, cand array<double>, h int, w int")
    small = bank.where(F.col("size") == size)
    got = {(r["id"], r["letter"]): r for r in M.match_patches(patches, small, 24).collect()}
    fits = {thin: match.patch_udf(lambda img, thin=thin: match.fitted(match.stroke_normalised(img) if thin else img, size), size) for thin in (False, True)}
    want: dict = {}
    for thin, fit in fits.items():
        b = small.where((F.col("style") == "skeleton") == thin)
        d = match.described(b, "ord", "tpl", size).drop("holes")
        p = match.described(patches.select("id", fit("cand", "h", "w").alias("cand")).cache(), "id", "cand", size)
        for style in [r[0] for r in b.select("style").distinct().collect()]:
            for r in match.match_letters(p, d.where(F.col("style") == style), size, 24).collect():
                key = (r["id"], r["letter"])
                if key not in want or r["score"] > want[key]["score"]:
                    want[key] = r
    assert set(got) == set(want) and len(got) == 6 * 24
    for key, r in want.items():
        assert got[key]["score"] == pytest.approx(r["score"], abs=1e-9), key
    ranked = sorted((r for r in got.values() if r["id"] == 0), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 25)) and all(a["score"] >= b["score"] for a, b in zip(ranked, ranked[1:], strict=False))


def test_odd_patches_and_banks(spark, bank):
    odd = spark.createDataFrame([(1, None, 2, 2), (2, [1.0], 2, 2), (3, [1.0, 0.0], 1, 2), (3, [1.0, 0.0], 1, 2), (4, [], 0, 0), (5, [1.0], None, 1)], "id long, cand array<double>, h int, w int")
    got = M.match_patches(odd, bank.where("size = 32"), 2).collect()
    assert sorted(r["id"] for r in got) == [3, 3, 3, 3, 4, 4]
    assert M.match_patches(odd, bank.limit(0), 2).count() == 0
    assert M.match_patches(odd.limit(0), bank, 2).count() == 0
    with pytest.raises(ValueError, match="at most"):
        M.match_patches(odd, bank.crossJoin(spark.range(20)), 2)
