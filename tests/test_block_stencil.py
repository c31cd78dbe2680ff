"""Stencils, small objects and distances on block rows against those on pixel rows and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import block_stencil as B
from glyphgrid.operators import graph, match, stencil
from glyphgrid.operators.stencil import extents


def grid(spark, h=37, w=29):
    d = spark.range(2 * h * w)
    at = lambda n, m: (F.floor(F.col("id") / n) % m).cast("int")
    return d.select(F.concat(F.lit("s"), at(h * w, 2).cast("string")).alias("seg_id"), at(w, h).alias("y"), at(1, w).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("p"))


def rows(d):
    return {(r["seg_id"], r["y"], r["x"]): r["p"] for r in d.collect()}


def ones(d):
    return {k for k, v in rows(d).items() if v > 0}


@pytest.mark.parametrize("size", [8, 16, 64])
def test_stencils_equal_those_on_pixels(spark, size):
    g = grid(spark).cache()
    blocks, ext = B.map_blocks(g, size), extents(g)
    assert rows(B.pixels(blocks, size)) == rows(g)
    assert rows(B.pixels(B.median_filter(blocks, size), size)) == pytest.approx(rows(stencil.median_filter(g)))
    side = 2 * min(size, 14) + 1
    assert rows(B.pixels(B.box_mean(blocks, size, side), size)) == pytest.approx(rows(stencil.box_mean(g, side)))
    assert rows(B.pixels(B.box_mean(blocks, size, 6), size)) == pytest.approx(rows(stencil.box_mean(g, 6)))
    ink = g.where("p > 0.8")
    got = lambda *steps: ones(B.pixels(B.morphology(blocks, size, 0.8, *steps), size))
    pixels = lambda d: {tuple(r) for r in d.collect()}
    assert got(("dilate", 1)) == pixels(stencil.dilate(ink, ext, 1))
    assert got(("dilate", 2), ("erode", 2)) == pixels(stencil.closing(ink, ext, 2))
    assert got(("erode", 1), ("dilate", 1)) == pixels(stencil.opening(ink, ext, 1))
    assert rows(B.pixels(B.filtered(blocks, size, level=0.45), size)) == pytest.approx(rows(stencil.filtered(g, level=0.45, enhance=None)))


def test_a_wide_stencil_needs_large_blocks(spark):
    with pytest.raises(ValueError, match="larger blocks"):
        B.box_mean(B.map_blocks(grid(spark), 8), 8, 19)


@pytest.mark.parametrize(("size", "eight"), [(8, False), (8, True), (5, False), (64, False)])
def test_small_objects(spark, size, eight):
    g = grid(spark)
    ink = g.where("p > 0.55")
    want = graph.remove_small(graph.label_components(ink, 29, eight=eight, block=16), 6).select("seg_id", "y", "x")
    got = ones(B.pixels(B.remove_small(B.map_blocks(g, size), size, 0.55, 6, eight=eight), size))
    assert got == {tuple(r) for r in want.collect()} and got


def nearest(ink):
    """Distances by trying all ink for every cell."""
    y, x = np.nonzero(ink)
    out = np.zeros(ink.shape)
    for i in range(ink.shape[0]):
        for j in range(ink.shape[1]):
            out[i, j] = np.sqrt(((y - i) ** 2 + (x - j) ** 2).min()) if len(y) else 0
    return out


@pytest.mark.parametrize("side", [1, 2, 8, 32, 48, 64])
def test_distances_of_patches(spark, side):
    rng = np.random.default_rng(side)
    patches = [rng.random((side, side)) < share for share in (0, 0.002, 0.02, 0.3, 1)]
    patches += [np.eye(side) > 0, np.indices((side, side))[0] == 0]
    df = spark.createDataFrame([(i, [float(v) for v in p.ravel()]) for i, p in enumerate(patches)], "id int, cand array<double>")
    got = {r["id"]: np.array(r["dt"]).reshape(side, side) for r in match.distance_transform(df, "cand", side).collect()}
    for i, p in enumerate(patches):
        np.testing.assert_allclose(got[i], nearest(p), atol=1e-9)


@pytest.mark.parametrize("size", [7, 16, 64])
def test_distances_across_blocks(spark, size):
    g = grid(spark, 37, 29).withColumn("p", F.when(F.col("seg_id") == "s1", F.lit(0.0)).otherwise(F.col("p")))
    got = rows(B.pixels(B.distance_transform(B.map_blocks(g, size), size, 0.97), size))
    img = np.zeros((37, 29))
    for (seg, y, x), p in rows(g).items():
        if seg == "s0":
            img[y, x] = p
    want = nearest(img > 0.97)
    assert all(got["s0", y, x] == pytest.approx(want[y, x]) for y in range(37) for x in range(29))
    assert all(v == 0 for (seg, _, _), v in got.items() if seg == "s1")


def test_no_blocks(spark):
    none = B.map_blocks(grid(spark).where("false"), 8)
    assert B.median_filter(none, 8).count() == 0
    assert B.remove_small(none, 8, 0.5, 2).count() == 0
    assert B.distance_transform(none, 8).count() == 0


def test_a_plan_has_no_row_for_each_pixel_and_offset(spark):
    plan = B.filtered(spark.createDataFrame([], B.MAP_SCHEMA), 16)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
