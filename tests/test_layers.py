"""The layer source: ranges, pushed conditions, streams that stop and start again."""

import glob
import io
import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import block_tiles, reduce
from glyphgrid.operators.tiles import patch_rows
from glyphgrid.sources import blocks, layers, raster


def image(seed, h=21, w=17):
    return np.random.default_rng(seed).integers(0, 256, (h, w), np.uint8)


def strip_tiff(img, rows, deflate=False):
    """An image in several strips."""
    parts = [img[y : y + rows].tobytes() for y in range(0, len(img), rows)]
    parts = [zlib.compress(p) for p in parts] if deflate else parts
    n, kind = len(parts), {1: 8, 2: 16}[img.dtype.itemsize]
    tags = [(256, 4, [img.shape[1]]), (257, 4, [len(img)]), (258, 3, [kind]), (259, 3, [8 if deflate else 1]), (277, 3, [1]), (278, 4, [rows])]
    head = 8 + 2 + 12 * 8 + 4
    starts = np.cumsum([head + 8 * n] + [len(p) for p in parts])[:-1].tolist()
    tags = sorted([*tags, (273, 4, starts), (279, 4, [len(p) for p in parts])])
    entries, at = b"", head
    long = {273: head, 279: head + 4 * n}
    for tag, k, v in tags:
        value = struct.pack("<I", long[tag]) if tag in long and n > 1 else struct.pack("<HH", v[0], 0) if k == 3 else struct.pack("<I", v[0])
        entries += struct.pack("<HHI", tag, k, len(v)) + value
    lists = struct.pack(f"<{n}I", *starts) + struct.pack(f"<{n}I", *(len(p) for p in parts))
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + lists + b"".join(parts)


def put(root, seg, z, data, end="npy"):
    os.makedirs(f"{root}/{seg}/layers", exist_ok=True)
    path = f"{root}/{seg}/layers/{z:02d}.{end}"
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.rename(f"{path}.part", path)


def npy(img):
    out = io.BytesIO()
    np.save(out, img)
    return out.getvalue()


def cells(images):
    return {(seg, z, y, x): int(img[y, x]) for (seg, z), img in images.items() for y in range(img.shape[0]) for x in range(img.shape[1])}


def got(df):
    found = df.collect()
    out = {(r["seg_id"], r["z"], r["y"], r["x"]): r["v"] for r in found}
    assert len(out) == len(found)
    return out


def test_files_of_several_kinds(spark, tmp_path):
    wide = (image(5).astype(np.uint16) << 8) + 7
    images = {("s1", 0): image(0), ("s1", 1): image(1), ("s1", 2): image(2), ("s2", 3): image(3), ("s2", 40): wide >> 8}
    put(tmp_path, "s1", 0, npy(images["s1", 0]))
    put(tmp_path, "s1", 1, strip_tiff(images["s1", 1], 5), "tif")
    put(tmp_path, "s1", 2, strip_tiff(images["s1", 2], 4, deflate=True), "tif")
    put(tmp_path, "s2", 3, raster.encode_png(images["s2", 3]), "png")
    put(tmp_path, "s2", 40, npy(wide))
    (tmp_path / "s1" / "notes.txt").write_text("no layer")
    df = layers.read_layers(spark, str(tmp_path), rangeBytes=60)
    assert got(df) == cells(images)
    assert got(layers.read_layers(spark, f"file://{tmp_path}")) == cells(images)
    ranges = {(f[1], f[2]): len(layers.row_ranges(*f, 60)) for f in layers.list_layers(str(tmp_path))}
    assert ranges["s1", 0] == ranges["s1", 1] == 7 and ranges["s1", 2] == ranges["s2", 3] == 1
    assert layers.read_layers(spark, str(tmp_path / "nothing")).count() == 0


def test_conditions_choose_files(spark, tmp_path):
    images = {(seg, z): image(z) for seg in ("s1", "s2", "s3") for z in range(4)}
    for (seg, z), img in images.items():
        put(tmp_path, seg, z, npy(img))
    put(tmp_path, "s9", 1, b"not an image at all")  # fails if it is opened
    df = layers.read_layers(spark, str(tmp_path)).where("seg_id in ('s1', 's3') and z > 0 and z <= 2 and v > 100")
    want = {k: v for k, v in cells(images).items() if k[0] in ("s1", "s3") and 0 < k[1] <= 2 and v > 100}
    assert got(df) == want
    assert df.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match=r"TIFF|KeyError"):
        layers.read_layers(spark, str(tmp_path)).count()


def test_written_layers_come_back(spark, tmp_path):
    d = spark.range(2 * 3 * 600 * 5)
    at = lambda n, m: (F.floor(F.col("id") / n) % m).cast("int")
    vox = d.select(F.concat(F.lit("s"), at(9000, 2).cast("string")).alias("seg_id"), at(3000, 3).alias("z"), at(5, 600).alias("y"), at(1, 5).alias("x"), F.pmod(F.xxhash64("id"), F.lit(256)).cast("int").alias("v"))
    # a layer whose first and last rows have no values
    vox = vox.where("not (seg_id = 's1' and z = 1 and (y < 300 or y > 320))").cache()
    assert layers.write_layers(vox, str(tmp_path / "out")).count() == 6
    assert not glob.glob(f"{tmp_path}/out/**/*.part", recursive=True)
    read = layers.read_layers(spark, str(tmp_path / "out"))
    assert read.count() == 2 * 3 * 600 * 5
    assert got(read.where("v > 0")) == got(vox.where("v > 0"))
    assert np.load(f"{tmp_path}/out/s0/layers/02.npy").shape == (600, 5)


def test_stream_stopped_and_started_again(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    images = {("s1", z): image(z, 5, 6) for z in range(9)}

    def start():
        d = layers.stream_layers(spark, str(root), str(tmp_path / "log"), filesPerBatch=2)
        return d.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        until = time.time() + 60
        while time.time() < until:
            if os.path.isdir(out) and spark.read.schema(layers.SCHEMA).parquet(str(out)).count() >= n * 30:
                return
            time.sleep(0.3)
        raise AssertionError("the stream stands still")

    for z in range(4):
        put(root, "s1", z, npy(images["s1", z]))
    q = start()
    wait(2)  # in the middle
    q.stop()
    for z in range(4, 7):
        put(root, "s1", z, npy(images["s1", z]))
    q = start()
    wait(7)
    put(root, "s1", 8, npy(images["s1", 8]))
    wait(8)
    put(root, "s1", 7, npy(images["s1", 7]))  # a lower number later
    wait(9)
    q.stop()
    assert got(spark.read.parquet(str(out))) == cells(images)


def plain_percentile(values, q):
    v = sorted(x for x in values if x is not None and x == x)
    at = q * (len(v) - 1)
    a, b = v[int(np.floor(at))], v[int(np.ceil(at))]
    return a if a == b else a * (1 - (at - np.floor(at))) + b * (at - np.floor(at))


@pytest.mark.parametrize("bins", [64, 1024])
def test_exact_percentiles(spark, bins):
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=501).tolist(), "steep": (10.0 ** rng.uniform(-300, 300, 400)).tolist(), "few": [1.0, 2.0] * 50 + [3.0], "one": [4.5],
        "signs": (rng.normal(size=300) * 10.0 ** rng.uniform(-20, 20, 300)).tolist() + [0.0, -0.0], "none": [None, float("nan")], "mixed": [None, float("nan"), 1.0, 2.5],
        "widest": [-1.7e308, 1.7e308, 0.0, 1.0, 5e-324], "equal": [0.1] * 77, "ends": [float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("inf")],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "seg_id string, v double").repartition(5)
    shares = {"low": 0.01, "quarter": 0.25, "half": 0.5, "high": 0.99, "least": 0.0, "most": 1.0}
    found = {r["seg_id"]: r for r in reduce.exact_percentiles(df, "v", shares, bins=bins).collect()}
    assert set(found) == set(groups) - {"none"}
    for g, row in found.items():
        for name, q in shares.items():
            want = plain_percentile(groups[g], q)
            assert row[name] == pytest.approx(want, rel=1e-12) or (np.isnan(want) and np.isnan(row[name])), (g, name)


def test_patches_by_a_table_function(spark):
    d = spark.range(2 * 3 * 40 * 50)
    at = lambda n, m: (F.floor(F.col("id") / n) % m).cast("int")
    vox = d.select(F.concat(F.lit("s"), at(6000, 2).cast("string")).alias("seg_id"), at(2000, 3).alias("z"), at(50, 40).alias("y"), at(1, 50).alias("x"), (1 + F.pmod(F.xxhash64("id"), F.lit(255))).cast("int").alias("v"))
    want = {(r["seg_id"], r["ty"], r["tx"]): [v / 255 for v in r["img"]] for r in patch_rows(vox, 16, 9).collect()}
    block_tiles.register_functions(spark)
    pieces = block_tiles.tile_pieces(blocks.to_blocks(vox, 8), 16, 9, 8)
    rows = spark.sql("SELECT * FROM patch_rows(TABLE({p}) PARTITION BY (seg_id, ty, tx), 16)", p=pieces).collect()
    assert {(r["seg_id"], r["ty"], r["tx"]): r["layers"] for r in rows} == dict.fromkeys(want, 3) and len(rows) == len(want)
    for r in rows:
        assert r["img"] == pytest.approx(want[r["seg_id"], r["ty"], r["tx"]], rel=1e-6)
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM patch_rows(TABLE({p}) PARTITION BY (seg_id, ty), 16)", p=pieces.select("seg_id", "ty")).collect()
