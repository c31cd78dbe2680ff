"""The keyed loop (restart, deadline), progress by observation, and images put together from strips."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import block_stencil
from glyphgrid.operators.progress import watched, watched_inference
from glyphgrid.sources import raster, strips
from glyphgrid.streaming.loop import LOG, LoopSettings, decided, loop_log


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def batch_log(steps, s):
    """The same loops, run one after another."""
    out = []
    for seg, changes in steps.items():
        for version, changed in enumerate(changes, 1):
            status = decided(changes[:version], version, s)
            out.append((seg, version, changed, status))
            if status != "running":
                break
    return sorted(out)


def drive(spark, tmp_path, settings):
    d = spark.readStream.schema("seg_id string, step int, changed double").json(str(tmp_path / "in"))
    return loop_log(d, settings).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()


def put(spark, tmp_path, name, rows):
    part = tmp_path / "parts" / name
    spark.createDataFrame(rows, "seg_id string, step int, changed double").coalesce(1).write.json(str(part))
    os.makedirs(tmp_path / "in", exist_ok=True)
    (file,) = part.glob("part-*.json")
    os.rename(file, tmp_path / "in" / f"{name}.json")


def wait(spark, tmp_path, want, q):
    until = time.time() + 120
    got = []
    while time.time() < until and q.isActive:
        if (tmp_path / "out").is_dir():
            got = sorted((tuple(r) for r in spark.read.schema(LOG).parquet(str(tmp_path / "out")).collect()), key=str)
            if len(got) >= len(want):
                break
        time.sleep(0.5)
    assert got == sorted(want, key=str), q.exception()


def test_loop_goes_on_at_its_version(rocksdb, tmp_path):
    s = LoopSettings(most=5, calm=0.01, patience=2)
    steps = {"a": [0.3, 0.2, 0.005, 0.004], "b": [0.3, 0.3, 0.005, 0.2, 0.1], "c": [0.001]}
    want = batch_log(steps, s)
    put(rocksdb, tmp_path, "one", [("a", 1, 0.3), ("b", 1, 0.3), ("b", 3, 0.005), ("a", 1, 0.3)])  # a repeated one, one too early
    q = drive(rocksdb, tmp_path, s)
    try:
        wait(rocksdb, tmp_path, [r for r in want if r[0] != "c" and r[1] == 1], q)
        q.stop()
        put(rocksdb, tmp_path, "two", [("b", 2, 0.3), ("a", 2, 0.2), ("a", 3, 0.005), ("c", 1, 0.001), ("a", 1, 0.9)])
        q = drive(rocksdb, tmp_path, s)
        put(rocksdb, tmp_path, "three", [("b", 4, 0.2), ("b", 5, 0.1), ("a", 4, 0.004), ("a", 5, 0.9), ("b", 6, 0.9)])
        wait(rocksdb, tmp_path, want, q)
    finally:
        q.stop()
    assert {r[0]: r[3] for r in want} == {"a": "converged", "b": "finished", "c": "running"}


def test_loop_ends_at_its_deadline(rocksdb, tmp_path):
    put(rocksdb, tmp_path, "one", [("a", 1, 0.3), ("b", 1, 0.3)])
    s = LoopSettings(most=2, seconds=4.0)
    q = drive(rocksdb, tmp_path, s)
    try:
        put(rocksdb, tmp_path, "two", [("b", 2, 0.3)])  # ends before
        wait(rocksdb, tmp_path, [("a", 1, 0.3, "running"), ("b", 1, 0.3, "running"), ("b", 2, 0.3, "finished"), ("a", 1, None, "deadline")], q)
        put(rocksdb, tmp_path, "three", [("a", 2, 0.3)])  # too late
        time.sleep(3)
        wait(rocksdb, tmp_path, [("a", 1, 0.3, "running"), ("b", 1, 0.3, "running"), ("b", 2, 0.3, "finished"), ("a", 1, None, "deadline")], q)
    finally:
        q.stop()


def test_progress_comes_with_the_job(spark, tmp_path):
    d = spark.range(1000).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("seg_id"), (F.col("id") / 1000).alias("p"))
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    out, progress = watched_inference(None, d.mapInArrow(count, "seg_id string, p double"), F.col("p"))
    out.write.parquet(str(tmp_path / "p"))
    seen = progress.observed()
    assert (seen["rows"], seen["ink"], seen["segments"], runs.value) == (1000, 499, 3, 1000)
    assert seen["mean"] == pytest.approx(spark.read.parquet(str(tmp_path / "p")).agg(F.avg("p")).first()[0])
    none, progress = watched(d.where("false"), F.col("p"), "nothing")
    none.collect()
    assert progress.observed() == {"rows": 0, "mean": None}


@pytest.mark.parametrize(("size", "h", "w"), [(8, 37, 29), (64, 5, 3), (5, 5, 11)])
def test_images_from_strips(spark, tmp_path, size, h, w):
    d = spark.range(2 * h * w)
    at = lambda n, m: (F.floor(F.col("id") / n) % m).cast("int")
    g = d.select(F.concat(F.lit("s"), at(h * w, 2).cast("string")).alias("seg_id"), at(w, h).alias("y"), at(1, w).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(1001)) / 1000.0).alias("p"))
    pieces = strips.tiff_pieces(block_stencil.map_blocks(g, size), size)
    rows = strips.write_files(pieces, str(tmp_path / "images")).collect()
    assert {r["seg_id"] for r in rows} == {"s0", "s1"}
    largest = max(len(r["data"]) for r in pieces.collect())
    for r in rows:
        data = open(r["path"], "rb").read()
        assert len(data) == r["length"]
        img = raster.decode_tiff(data)
        want = np.zeros((h, w), np.uint8)
        for x in g.where(F.col("seg_id") == r["seg_id"]).collect():
            want[x["y"], x["x"]] = int(x["p"] * 255)
        np.testing.assert_array_equal(img, want)
    assert h <= size or largest < min(r["length"] for r in rows)
