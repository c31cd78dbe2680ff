"""Small grids with answers worked out by hand, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.functions import scalars as S
from glyphgrid.operators import graph, lines, match, metrics, reduce, responses, stencil, tiles
from glyphgrid.sources import raster

PROB = "seg_id string, y int, x int, p double"


def grid(spark, rows, seg="s"):
    """A map from lines of text: # is 1, . is 0, digits are tenths."""
    value = lambda c: {"#": 1.0, ".": 0.0}.get(c, None)
    return spark.createDataFrame([(seg, y, x, value(c) if value(c) is not None else int(c) / 10) for y, r in enumerate(rows) for x, c in enumerate(r)], PROB)


def ink(df):
    return df.where("p > 0.5")


def picture(df, h, w):
    at = {(r["y"], r["x"]) for r in df.collect()}
    return ["".join("#" if (y, x) in at else "." for x in range(w)) for y in range(h)]


def closed(rows, r=2):
    """Brute force: dilation, then erosion, places outside the image not counting."""
    h, w = len(rows), len(rows[0])
    a = np.array([[c == "#" for c in r] for r in rows])
    d = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r]
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    grown = np.array([[any(inside(y + i, x + j) and a[y + i, x + j] for i, j in d) for x in range(w)] for y in range(h)])
    return ["".join("#" if all(grown[y + i, x + j] for i, j in d if inside(y + i, x + j)) else "." for x in range(w)) for y in range(h)]


@pytest.mark.parametrize("rows", [[".....", ".....", "..#..", ".....", "....."], ["#####"] * 5, ["##..##.", "##..##.", "##..##.", ".......", "......."], ["#......", ".......", "......#", ".......", "#.....#"]])
def test_closing_and_opening(spark, rows):
    g = grid(spark, rows)
    ext = stencil.extents(g)
    got = picture(stencil.closing(ink(g), ext, 2), len(rows), len(rows[0]))
    assert got == closed(rows)
    opened = picture(stencil.opening(ink(g), ext, 1), len(rows), len(rows[0]))
    assert all(o != "#" or r == "#" for a, b in zip(opened, rows, strict=True) for o, r in zip(a, b, strict=True))
    assert all(r != "#" or c == "#" for a, b in zip(rows, got, strict=True) for r, c in zip(a, b, strict=True))


def test_four_and_eight_connectivity(spark):
    g = ink(grid(spark, ["#...", ".#..", "..##", "#..."]))
    four = {(r["y"], r["x"]): r["label"] for r in graph.label_components(g, 4, block=2).collect()}
    assert len(set(four.values())) == 4 and four[2, 2] == four[2, 3] == 10
    eight = graph.label_components(g, 4, eight=True, block=2)
    assert eight.select("label").distinct().count() == 2


@pytest.mark.parametrize("block", [2, 3, 64])
def test_components_join_across_blocks(spark, block):
    rows = ["#########", "........#", "#######.#", "#.....#.#", "#.###.#.#", "#.#...#.#", "#.#####.#", "#.......#", "#########"]
    g = ink(grid(spark, rows))
    assert graph.label_components(g, 9, block=block).select("label").distinct().collect()[0]["label"] == 0
    two = g.unionByName(ink(grid(spark, rows, seg="t")))
    assert graph.label_components(two, 9, block=block).select("seg_id", "label").distinct().count() == 2


def test_hole_counts(spark):
    rows = ["###.#####.#", "#.#.#.#.#.#", "###.#####.#"]
    lab = graph.label_components(ink(grid(spark, rows)), 11)
    assert {r["label"]: r["holes"] for r in graph.hole_counts(lab).collect()} == {0: 1, 4: 2, 10: 0}


def test_lines_are_measured_from_their_first_member(spark):
    c = spark.createDataFrame([(i, y, i, 10, 5, 0.5) for i, y in enumerate((0, 10, 20, 30))], "id long, cy int, cx int, h int, w int, mean_prob double")
    assert [r["line_id"] for r in lines.text_lines(c).orderBy("id").collect()] == [0, 0, 1, 1]
    assert lines.text_lines(c.limit(0)).count() == 0


def test_gaps_are_strict_and_rounded_to_even(spark):
    xs = [0, 25, 51, 86]  # widths of 10: 2.5 times isn't a gap; 2.6 and 3.5 are
    c = spark.createDataFrame([(i, 0, x, 10, 10, 0.5) for i, x in enumerate(xs)], "id long, cy int, cx int, h int, w int, mean_prob double")
    assert [(r["id"], r["missing"]) for r in lines.gaps(lines.text_lines(c)).orderBy("id").collect()] == [(2, 2), (3, 3)]


def test_tiers_and_bands(spark):
    d = spark.createDataFrame([(0.45,), (0.70,), (0.4499,), (0.71,)], "p double")
    assert [r[0] for r in d.select(S.tier(F.col("p"))).collect()] == ["MEDIUM", "MEDIUM", "LOW", "HIGH"]
    t = spark.createDataFrame([(0.4,), (0.6,), (0.5,), (0.39,), (0.61,)], "t double")
    assert [r[0] for r in t.select(metrics.supervised(F.col("t"))).collect()] == [False, False, False, True, True]


def test_overlap_counts_and_uncovered_rest(spark):
    for size, covered in ((10, 10), (9, 8)):
        g = spark.range(size * size).select(F.lit("s").alias("seg_id"), (F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"), F.lit(1.0).alias("p"))
        n = {(r["y"], r["x"]): r["n"] for r in tiles.tile_pixels(g, 4, 2).groupBy("y", "x").agg(F.count("*").alias("n")).collect()}
        assert set(n.values()) == {1, 2, 4} and max(y for y, _ in n) == covered - 1
        avg = tiles.overlap_average(g, tiles.tile_pixels(g, 4, 2).select("seg_id", "y", "x", "p"))
        assert avg.agg(F.sum("p")).first()[0] == covered * covered
    assert tiles.tile_pixels(g, 16, 2).count() == 0


def test_first_layer_wins_ties(spark):
    v = spark.createDataFrame([("s", z, 0, x, 7 if x else z) for z in range(3) for x in range(2)], "seg_id string, z int, y int, x int, v int")
    got = {r["x"]: r["depth"] for r in reduce.depth_map(v, keep=0.0).collect()}
    assert got[1] == 0


ANSWERS = {
    '```json\n{"positions": [{"pos": 0.5, "char": "A", "conf": 0.9, "source": "anchor"}]}\n```': [(0.5, "A", 0.9, "anchor")],
    'Here it is: {"positions": [{"pos": 0.25}]} as asked.': [(0.25, "?", 0.5, "llm_gap")],
    '{"line_id": 3, "positions": [{}, {"char": "B"}]}': [(0.0, "?", 0.5, "llm_gap"), (0.0, "B", 0.5, "llm_gap")],
    "{}": [],
    "no json": [],
    "": [],
}


def test_answers_are_parsed_with_fallbacks(spark):
    d = spark.createDataFrame(list(enumerate(ANSWERS)), "line_id int, block string")
    got = responses.predictions(d).orderBy("line_id", "ord").collect()
    for i, want in enumerate(ANSWERS.values()):
        assert [(r["pos"], r["char"], r["conf"], r["source"]) for r in got if r["line_id"] == i] == want


def test_too_few_and_surplus_blocks_and_errors(spark):
    d = spark.createDataFrame([(0, [0, 1, 2], "a---b", None), (1, [3], "c --- d", None), (2, [4, 5], None, "down")], "batch int, line_ids array<int>, raw string, error string")
    got = {r["line_id"]: (r["block"], r["error"]) for r in responses.blocks(d).collect()}
    assert got == {0: ("a", None), 1: ("b", None), 2: ("{}", None), 3: ("c", None), 4: (None, "down"), 5: (None, "down")}


def test_completer_errors_stay_with_their_rows(spark):
    def load():
        def ask(m):
            if "bad" in m:
                raise RuntimeError("refused")
            return m.upper()

        return ask

    d = spark.createDataFrame([(0, [0], "good"), (1, [1], "bad")], "batch int, line_ids array<int>, message string")
    got = {r["batch"]: (r["raw"], r["error"]) for r in responses.complete(d, load).collect()}
    assert got == {0: ("GOOD", None), 1: (None, "refused")}


def test_blobs_are_clamped_at_the_border(spark):
    g = grid(spark, ["." * 20] * 20)
    p = spark.createDataFrame([("s", -3.0, 25.0, 0.8, "llm_gap", None, None, None, None), ("s", 5.0, 5.0, 1.0, "anchor", 0, 0, 9, 9), ("s", 5.0, 5.0, 0.95, "llm_med", 10, -4, 12, 3)], "seg_id string, pos_y double, pos_x double, conf double, source string, y0 int, x0 int, y1 int, x1 int")
    out = {(r["y"], r["x"]): r["p"] for r in responses.paint(g, p).collect()}
    assert out[0, 19] == pytest.approx(0.6) and out[0, 0] == 0.0 and out[13, 19] == 0.0
    assert out[12 - 1, 2] == 0.90 and out[12, 2] == 0.0 and out[10, 3] < 0.1


def test_moments_do_not_depend_on_place(spark):
    cells = spark.createDataFrame([(k, y + d, x + d) for k, d in ((0, 0), (1, 9)) for y, x in ((0, 0), (0, 1), (1, 1), (2, 1), (3, 1))], "id int, y int, x int")
    a, b = (tuple(r)[1:] for r in match.hu_moments(cells, ["id"]).orderBy("id").collect())
    assert a == pytest.approx(b, abs=1e-6)


def test_patches_resized_thinned_and_cropped():
    bar = np.ones((10, 3))
    assert match.fitted(bar, 32).sum(axis=0).max() == 32 - 8 and match.fitted(bar, 32).any(axis=0).sum() == 7
    assert match.fitted(bar, 32, margin=3, truncate=True).any(axis=0).sum() == 7
    assert not match.fitted(np.ones((0, 3)), 16).any()
    assert match.centre_crop(np.arange(25).reshape(5, 5), 3).tolist() == [[6, 7, 8], [11, 12, 13], [16, 17, 18]]
    assert match.centre_crop(np.ones((2, 2)), 4).tolist() == [[0, 0, 0, 0], [0, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 0]]
    thin = match.skeleton(np.pad(np.ones((3, 15)), 2))
    assert thin.any() and thin.sum(axis=0).max() == 1
    assert (match.stroke_normalised(np.eye(2)) == np.eye(2)).all()


def test_turns_and_softmax(spark):
    g = grid(spark, ["012", "345"])
    back = g
    for _ in range(4):
        back = tiles.oriented(back, turns=1)
    assert {tuple(r) for r in back.select(*g.columns).collect()} == {tuple(r) for r in g.collect()}
    s = spark.createDataFrame([([0.9, 0.5, 0.1],)], "s array<double>").select(S.softmax(F.col("s")).alias("p")).first()["p"]
    assert sum(s) == pytest.approx(1) and s[0] > s[1] > s[2]


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (20, 30), np.uint8)
    assert (raster.decode_tiff(raster.encode_tiff(img)) == img).all()
    for z in range(3):
        d = tmp_path / "segment7" / "layers"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{z:02d}.tif").write_bytes(raster.encode_tiff(img + z))
    np.save(tmp_path / "wide.npy", (img.astype(np.uint16) << 8))
    vol = raster.read_volume(spark, str(tmp_path / "segment7"), z=(0, 2))
    assert vol.count() == 2 * 600 and vol.where("z = 1 and y = 3 and x = 4").first()["v"] == (int(img[3, 4]) + 1) % 256
    assert vol.first()["seg_id"] == "segment7"
    files = raster.layer_files(spark, str(tmp_path / "segment7"))
    assert raster.inventory(files).first()["layers"] == 3
    assert raster.complete_segments(files, files, layers=3, least=100).count() == 1
    wide = raster.read_map(spark, str(tmp_path / "wide.npy"))
    assert wide.where("y = 1 and x = 2").first()["v"] == int(img[1, 2]) << 8
    tiff = raster.images(grid(spark, ["#.", "5."])).first()["tiff"]
    assert raster.decode_tiff(bytes(tiff)).tolist() == [[255, 0], [127, 0]]


def test_maps_logs_and_versions(spark, tmp_path):
    g = grid(spark, ["#5", ".."])
    for v in (2, 10):
        raster.write_map(g, str(tmp_path / "maps"), v)
    maps = raster.read_versions(spark, str(tmp_path / "maps"))
    assert raster.latest_version(maps).first()["version"] == 10
    assert {r["byte"] for r in maps.collect()} == {255, 127, 0}
    log = str(tmp_path / "log")
    raster.append_log(spark, log, [{"iteration": 1, "mean": 0.5}])
    raster.append_log(spark, log, [{"iteration": 2, "mean": 0.25}])
    (tmp_path / "log" / "part-bad.json").write_text("not json\n")
    assert [r["iteration"] for r in raster.read_log(spark, log, "iteration int, mean double, timestamp string").orderBy("iteration").collect()] == [1, 2]
    (tmp_path / "meta.json").write_text('{"width": 3,\n "name": "s"}')
    assert raster.read_metadata(spark, str(tmp_path / "meta.json")).first()["width"] == 3


def test_equalisation_keeps_order_within_a_flat_image(spark):
    g = spark.range(256).select(F.lit("s").alias("seg_id"), (F.col("id") / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"), (F.col("id") % 16 / 15.0).alias("p"))
    out = stencil.equalised(g, tile=8)
    v = {(r["y"], r["x"]): r["p"] for r in out.collect()}
    assert len(v) == 256 and all(0 <= p <= 1 for p in v.values())
    assert all(v[8, x] <= v[8, x + 1] + 0.2 for x in range(15))
    flat = stencil.equalised(g.withColumn("p", F.lit(0.3)))
    assert flat.count() == 256


def test_losses_without_supervised_pixels(spark):
    d = spark.createDataFrame([("a", 0.0, 0.5)], "g string, logit double, t double")
    assert metrics.masked_soft_loss(d, ["g"], F.col("logit"), F.col("t")).first()["loss"] == 0.0
