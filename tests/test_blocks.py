"""Block rows: round trip, pruning and block-wise statistics."""

import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import tiles
from glyphgrid.operators.block_tiles import map_pixels, predict_blocks
from glyphgrid.operators.reduce import layer_stats
from glyphgrid.sources import blocks


def volume(spark):
    ids = spark.range(2 * 3 * 20 * 30)
    at = lambda d, m: (F.floor(F.col("id") / d) % m).cast("int")
    return ids.select(F.concat(F.lit("s"), at(1800, 2).cast("string")).alias("seg_id"), at(600, 3).alias("z"), at(30, 20).alias("y"), at(1, 30).alias("x"), F.pmod(F.xxhash64("id"), F.lit(256)).cast("int").alias("v"))


def test_round_trip_and_windows(spark, tmp_path):
    vox, path = volume(spark), str(tmp_path / "blocks")
    blocks.write_blocks(blocks.to_blocks(vox, 8), path)
    every = blocks.read_blocks(spark, path)
    assert every.count() == 2 * 3 * 3 * 4
    rows = lambda d: sorted(tuple(r) for r in d.select("seg_id", "z", "y", "x", "v").collect())
    assert rows(blocks.pixels(every, 8)) == rows(vox)
    window = (5, 12, 7, 20)
    some = blocks.read_blocks(spark, path, segments=["s1"], z=(1, 3), window=window, size=8)
    assert some.count() == 2 * 2 * 3
    assert rows(blocks.pixels(some, 8, window)) == rows(vox.where("seg_id = 's1' and z >= 1 and y >= 5 and y < 12 and x >= 7 and x < 20"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seg_id" in plan or "PartitionFilters: [(seg_id" in plan
    assert "GreaterThanOrEqual(z,1)" in plan


def test_statistics_without_pixel_rows(spark):
    vox = volume(spark)
    got = {(r["seg_id"], r["z"]): r for r in blocks.block_layer_stats(blocks.to_blocks(vox, 16)).collect()}
    for r in layer_stats(vox).collect():
        g = got[r["seg_id"], r["z"]]
        assert (g["n"], g["lo"], g["hi"]) == (r["n"], r["lo"], r["hi"])
        assert g["mean"] == pytest.approx(r["mean"]) and g["std"] == pytest.approx(r["std"])


def _uneven():
    """A model whose answer depends on the place in the tile and on the layers' order."""

    def ask(x):
        import numpy as np

        _, z, h, w = x.shape
        return np.tensordot(np.arange(1, z + 1) / 10, x, (0, 1)) * (1 + np.arange(h * w).reshape(h, w)) / (h * w)

    return ask


@pytest.mark.parametrize(("size", "tile", "stride"), [(8, 6, 4), (5, 12, 3), (16, 4, 4), (7, 7, 9)])
def test_inference_on_blocks_equals_that_on_voxels(spark, size, tile, stride):
    # a hole that some tiles lie in whole, and single empty cells
    hole = "(y between 2 and 13 and x between 4 and 17) or (y + x) % 7 = 0"
    vox = volume(spark).withColumn("v", F.when(F.expr(hole), 0).otherwise(F.col("v")))
    rows = lambda d: {(r["seg_id"], r["y"], r["x"]): r["p"] for r in d.where("p > 0").collect()}
    want = rows(tiles.predict_segment(vox, _uneven, tile, stride))
    filled = blocks.to_blocks(vox, size)
    got = rows(map_pixels(predict_blocks(filled, _uneven, tile, stride, size), size))
    assert want and got == pytest.approx(want, rel=1e-5)
    # blocks that are all 0 need no row, but for the last, which tells how far the map reaches
    fewer = filled.where(F.regexp_replace(F.hex("data"), "00", "") != "")
    assert rows(map_pixels(predict_blocks(fewer, _uneven, tile, stride, size), size)) == got


def test_inference_on_no_blocks(spark):
    none = spark.createDataFrame([], blocks.SCHEMA)
    assert map_pixels(predict_blocks(none, _uneven, 4, 2, 8), 8).count() == 0
