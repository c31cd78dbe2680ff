"""Random changes of patches, pooling over layers, fetching with broken transfers, and image readers."""

import io
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import augment, responses
from glyphgrid.sources import fetch


def volume(spark, v=0.5):
    return spark.range(5 * 8 * 8).select(F.lit("s").alias("seg_id"), (F.col("id") / 64).cast("int").alias("z"), (F.col("id") % 64 / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.lit(v).alias("v"))


def test_noise_is_fixed_by_its_seed(spark):
    v = volume(spark)
    one, two = (sorted(map(tuple, augment.noisy(v, ["seg_id"], seed=4).collect())) for _ in range(2))
    assert one == two and one != sorted(map(tuple, augment.noisy(v, ["seg_id"], seed=5).collect()))
    assert all(0 <= r[-1] <= 1 for r in one)
    plain = augment.noisy(v, ["seg_id"], sigma=0.0, brightness=0.0, drop=0.0)
    assert plain.select("v").distinct().collect()[0]["v"] == 0.5
    assert augment.noisy(v, ["seg_id"], drop=1.0).agg(F.max("v")).first()[0] == 0.0
    z = spark.range(20_000).select(augment.normal(1, F.col("id")).alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_layers_move_and_zeros_come_in(spark):
    v = volume(spark).withColumn("v", F.col("z") + 1.0)
    seen = set()
    for seed in range(12):
        got = [r["v"] for r in augment.shifted_layers(v, ["seg_id"], 1, seed).where("y = 0 and x = 0").orderBy("z").collect()]
        assert got in ([1, 2, 3, 4, 5], [0, 1, 2, 3, 4], [2, 3, 4, 5, 0])
        seen.add(got[0])
    assert len(seen) > 1


def test_patches_are_bent_moved_blurred_and_holed(spark):
    img = np.random.default_rng(0).random((24, 20))
    assert np.allclose(augment.elastic(img, 1, strength=0), img) and not np.allclose(augment.elastic(img, 1), img)
    assert (augment.elastic(img, 1) == augment.elastic(img, 1)).all()
    assert np.allclose(augment.moved(img, 1, 0, 0, 0), img) and augment.moved(img, 1).shape == img.shape
    assert np.allclose(augment.blurred(np.ones((5, 5))), 1) and augment.blurred(img).std() < img.std()
    assert (augment.holes(img, 3) == 0).any()
    change = augment.patch_change(augment.elastic, augment.holes)
    d = spark.createDataFrame([(img.ravel().tolist(), 24, 20, 7)], "v array<double>, h int, w int, seed int")
    assert np.allclose(d.select(change("v", "h", "w", "seed").alias("o")).first()["o"], augment.holes(augment.elastic(img, 7), 8).ravel())


def test_attention_pool_and_running_mean(spark):
    v = volume(spark).withColumn("v", F.col("z").cast("double"))
    even = augment.attention_pool(v, F.lit(0.0)).select("p").distinct().collect()
    assert [r["p"] for r in even] == [2.0]
    assert augment.attention_pool(v, F.col("v"), 50.0).agg(F.min("p")).first()[0] == pytest.approx(4.0)
    h = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 9.0)], "epoch int, loss double").withColumn("run", F.lit(0))
    assert [r["running_mean"] for r in augment.running_mean(h, "epoch", "loss", ["run"]).orderBy("epoch").collect()] == [2.0, 3.0, 5.0]


class Server:
    """Serves one file, breaking off after so many bytes a time."""

    def __init__(self, data, step):
        self.data, self.step, self.asked = data, step, []

    def __call__(self, request):
        at = int((request.headers.get("Range") or "bytes=0-")[6:-1])
        self.asked.append(at)
        if at >= len(self.data):
            raise urllib.error.HTTPError(request.full_url, 416, "out of range", {}, None)
        part = self.data[at : at + self.step]
        whole = at + len(part) == len(self.data)

        class Answer(io.BytesIO):
            status = 206 if at else 200

            def read(self, n=-1):
                got = super().read(n)
                if not got and not whole:
                    raise ConnectionError("broken off")
                return got

        return Answer(part)


def test_fetch_continues_and_skips(tmp_path):
    data, waits = bytes(range(256)) * 10, []
    s, path = Server(data, 1000), tmp_path / "a" / "00.tif"
    assert fetch.fetch_all([("http://h/a", str(path))], opener=s, sleep=waits.append) == [(str(path), None)]
    assert path.read_bytes() == data and s.asked == [0, 1000, 2000] and waits == [5.0, 10.0]
    assert fetch.fetch("http://h/a", str(path), opener=s) is False and len(s.asked) == 3
    (tmp_path / "b.part").write_bytes(data)
    assert fetch.fetch("http://h/b", str(tmp_path / "b"), opener=s) and (tmp_path / "b").read_bytes() == data
    got = fetch.fetch_all([("http://h/c", str(tmp_path / "c"))], opener=Server(data, 10), tries=2, sleep=waits.append)
    assert got[0][1] and not (tmp_path / "c").exists()


def test_image_readers(spark):
    def load():
        return lambda data: data.decode() if data != b"bad" else 1 / 0

    d = spark.createDataFrame([("a", bytearray(b"text")), ("b", bytearray(b"bad"))], "seg_id string, tiff binary")
    got = {r["seg_id"]: (r["text"], r["error"]) for r in responses.transcribe(d, load).collect()}
    assert got["a"] == ("text", None) and got["b"][0] is None and "zero" in got["b"][1]
