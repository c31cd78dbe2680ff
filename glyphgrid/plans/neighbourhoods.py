"""Stencils, components, tiles and alignment of maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import augment, block_stencil, block_tiles, graph, isosurface, metrics, networks, reduce, stencil, tiles
from ..session import work_path, written
from ..sources import blocks, layers
from .catalog import query

R = lambda c, n=6: F.round(c, n)

# a complete 64 x 64 image of each segment: cells without a row are 0
_GRID = """, cells AS (SELECT seg_id, cast(y AS int) AS y, cast(x AS int) AS x FROM (SELECT DISTINCT seg_id FROM prob), range(64) a(y), range(64) b(x)),
grid AS (SELECT c.seg_id, c.y, c.x, coalesce(p.p, 0) AS p FROM cells c LEFT JOIN prob p ON p.seg_id = c.seg_id AND p.y = c.y AND p.x = c.x)
"""


def _grid(t):
    cells = t.prob.select("seg_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return cells.join(t.prob, ["seg_id", "y", "x"], "left").select("seg_id", "y", "x", F.coalesce("p", F.lit(0.0)).alias("p"))


def _offsets(radius: int) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, dx in stencil.disk(radius))


_MIRROR = "CASE WHEN {c} < 0 THEN -1 - {c} WHEN {c} > 63 THEN 127 - {c} ELSE {c} END"
_MEDIAN = f""", n AS (SELECT g.seg_id, g.y, g.x, {_MIRROR.format(c="(g.y + a.d)")} AS ny, {_MIRROR.format(c="(g.x + b.d)")} AS nx FROM grid g, range(-1, 2) a(d), range(-1, 2) b(d)),
med AS (SELECT n.seg_id, n.y, n.x, median(g.p) AS p FROM n JOIN grid g ON g.seg_id = n.seg_id AND g.y = n.ny AND g.x = n.nx GROUP BY ALL)
"""


@query(_GRID + _MEDIAN + "SELECT seg_id, y, x, round(p, 6) AS p FROM med", uses="prob")
def w1_median_filter(t):
    return stencil.median_filter(_grid(t)).withColumn("p", R("p"))


_BOX = """, n AS (SELECT g.seg_id, g.y, g.x, CASE WHEN g.y + d < 0 THEN -1 - (g.y + d) WHEN g.y + d > 63 THEN 127 - (g.y + d) ELSE g.y + d END AS ny FROM grid g, range(-15, 16) r(d)),
v AS (SELECT n.seg_id, n.y, n.x, avg(g.p) AS p FROM n JOIN grid g ON g.seg_id = n.seg_id AND g.y = n.ny AND g.x = n.x GROUP BY ALL),
m AS (SELECT g.seg_id, g.y, g.x, CASE WHEN g.x + d < 0 THEN -1 - (g.x + d) WHEN g.x + d > 63 THEN 127 - (g.x + d) ELSE g.x + d END AS nx FROM grid g, range(-15, 16) r(d)),
box AS (SELECT m.seg_id, m.y, m.x, avg(v.p) AS p FROM m JOIN v ON v.seg_id = m.seg_id AND v.y = m.y AND v.x = m.nx GROUP BY ALL)
"""


@query(_GRID + _BOX + "SELECT seg_id, y, x, round(p, 6) AS p FROM box", uses="prob")
def w2_box_mean(t):
    return stencil.box_mean(_grid(t), 31).withColumn("p", R("p"))


@query(_GRID + _BOX + "SELECT g.seg_id, g.y, g.x, cast(CASE WHEN g.p > box.p + 0.05 THEN 1 ELSE 0 END AS double) AS p FROM grid g JOIN box USING (seg_id, y, x)", uses="prob")
def w3_adaptive_threshold(t):
    return stencil.adaptive_threshold(_grid(t))


def _dilated(name: str, src: str, radius: int) -> str:
    return f", {name} AS (SELECT DISTINCT seg_id, y + dy AS y, x + dx AS x FROM {src}, (VALUES {_offsets(radius)}) o(dy, dx) WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63)\n"


def _eroded(name: str, src: str, radius: int) -> str:
    return f""", {name}_need AS (SELECT c.seg_id, c.y, c.x, c.y + dy AS ny, c.x + dx AS nx FROM cells c, (VALUES {_offsets(radius)}) o(dy, dx) WHERE c.y + dy BETWEEN 0 AND 63 AND c.x + dx BETWEEN 0 AND 63),
{name} AS (SELECT n.seg_id, n.y, n.x FROM {name}_need n LEFT JOIN {src} s ON s.seg_id = n.seg_id AND s.y = n.ny AND s.x = n.nx GROUP BY ALL HAVING count(*) = count(s.seg_id))
"""


_INK = ", ink AS (SELECT seg_id, y, x FROM grid WHERE p > 0.75)\n"
_OUT = "SELECT seg_id, cast(y AS int) AS y, cast(x AS int) AS x FROM "


@query(_GRID + _INK + _dilated("d", "ink", 1) + _OUT + "d", uses="prob")
def w5_dilation(t):
    g = _grid(t)
    return stencil.dilate(g.where("p > 0.75"), stencil.extents(g), 1)


@query(_GRID + _INK + _dilated("d", "ink", 2) + _eroded("e", "d", 2) + _OUT + "e", uses="prob")
def w6_closing(t):
    g = _grid(t)
    return stencil.closing(g.where("p > 0.75"), stencil.extents(g), 2)


@query(_GRID + ", ink AS (SELECT seg_id, y, x FROM grid WHERE p > 0.3)\n" + _eroded("e", "ink", 1) + _dilated("d", "e", 1) + _OUT + "d", uses="prob")
def w7_opening(t):
    g = _grid(t)
    return stencil.opening(g.where("p > 0.3"), stencil.extents(g), 1)


@query(_GRID + _MEDIAN + """, mix AS (SELECT g.seg_id, g.y, g.x, cast(0.7 AS double) * m.p + cast(0.3 AS double) * g.p AS p FROM grid g JOIN med m USING (seg_id, y, x)),
ink AS (SELECT seg_id, y, x FROM mix WHERE p > 0.45)
""" + _dilated("a", "ink", 2) + _eroded("b", "a", 2) + _eroded("c", "b", 1) + _dilated("d", "c", 1) + "SELECT m.seg_id, m.y, m.x, round(CASE WHEN d.seg_id IS NULL THEN 0 ELSE m.p END, 6) AS p FROM mix m LEFT JOIN d USING (seg_id, y, x)", uses="prob")
def w8_filter_chain(t):
    return stencil.filtered(_grid(t), level=0.45, enhance=None).withColumn("p", R("p"))


_BLOCK = 16


def _map_blocks(t):
    return block_stencil.map_blocks(_grid(t), _BLOCK)


def _ones(b):
    return block_stencil.pixels(b, _BLOCK).where("p > 0").select("seg_id", "y", "x")


@query(_GRID + _MEDIAN + "SELECT seg_id, y, x, round(p, 6) AS p FROM med", uses="prob")
def w1_block_median_filter(t):
    """The filters of this and the following queries run on block rows, by halo exchange."""
    return block_stencil.pixels(block_stencil.median_filter(_map_blocks(t), _BLOCK), _BLOCK).withColumn("p", R("p"))


@query(_GRID + _BOX + "SELECT seg_id, y, x, round(p, 6) AS p FROM box", uses="prob")
def w2_block_box_mean(t):
    return block_stencil.pixels(block_stencil.box_mean(_map_blocks(t), _BLOCK, 31), _BLOCK).withColumn("p", R("p"))


@query(_GRID + _BOX + "SELECT g.seg_id, g.y, g.x, cast(CASE WHEN g.p > box.p + 0.05 THEN 1 ELSE 0 END AS double) AS p FROM grid g JOIN box USING (seg_id, y, x)", uses="prob")
def w3_block_adaptive_threshold(t):
    return block_stencil.pixels(block_stencil.adaptive_threshold(_map_blocks(t), _BLOCK), _BLOCK)


@query(_GRID + _INK + _dilated("d", "ink", 1) + _OUT + "d", uses="prob")
def w5_block_dilation(t):
    return _ones(block_stencil.morphology(_map_blocks(t), _BLOCK, 0.75, ("dilate", 1)))


@query(_GRID + _INK + _dilated("d", "ink", 2) + _eroded("e", "d", 2) + _OUT + "e", uses="prob")
def w6_block_closing(t):
    return _ones(block_stencil.morphology(_map_blocks(t), _BLOCK, 0.75, ("dilate", 2), ("erode", 2)))


@query(_GRID + ", ink AS (SELECT seg_id, y, x FROM grid WHERE p > 0.3)\n" + _eroded("e", "ink", 1) + _dilated("d", "e", 1) + _OUT + "d", uses="prob")
def w7_block_opening(t):
    return _ones(block_stencil.morphology(_map_blocks(t), _BLOCK, 0.3, ("erode", 1), ("dilate", 1)))


@query(_GRID + _MEDIAN + """, mix AS (SELECT g.seg_id, g.y, g.x, cast(0.7 AS double) * m.p + cast(0.3 AS double) * g.p AS p FROM grid g JOIN med m USING (seg_id, y, x)),
ink AS (SELECT seg_id, y, x FROM mix WHERE p > 0.45)
""" + _dilated("a", "ink", 2) + _eroded("b", "a", 2) + _eroded("c", "b", 1) + _dilated("d", "c", 1) + "SELECT m.seg_id, m.y, m.x, round(CASE WHEN d.seg_id IS NULL THEN 0 ELSE m.p END, 6) AS p FROM mix m LEFT JOIN d USING (seg_id, y, x)", uses="prob")
def w8_block_filter_chain(t):
    """The whole chain after one exchange."""
    return block_stencil.pixels(block_stencil.filtered(_map_blocks(t), _BLOCK, level=0.45), _BLOCK).withColumn("p", R("p"))


@query(_GRID + ", ink AS (SELECT seg_id, y, x FROM grid WHERE p > 0.93)\n" + """SELECT g.seg_id, g.y, g.x, round(sqrt(min((g.y - i.y) * (g.y - i.y) + (g.x - i.x) * (g.x - i.x))), 6) AS p
FROM grid g JOIN ink i ON i.seg_id = g.seg_id GROUP BY ALL""", uses="prob")
def w10_block_distance_transform(t):
    """Distance of every pixel of a map to the nearest ink, by strips of blocks."""
    return block_stencil.pixels(block_stencil.distance_transform(_map_blocks(t), _BLOCK, 0.93), _BLOCK).withColumn("p", R("p"))


@query()
def w4_w8_filter_chain_with_equalisation(t):
    return stencil.filtered(_grid(t)).withColumn("p", R("p"))


# components of ink above a level; the label of a component is its least pixel
_LABELS = """, e AS (SELECT a.seg_id, a.y * 64 + a.x AS a, b.y * 64 + b.x AS b FROM ink a JOIN ink b ON a.seg_id = b.seg_id AND {near}),
r AS (SELECT seg_id, y * 64 + x AS px, y * 64 + x AS root FROM ink UNION SELECT r.seg_id, e.b, r.root FROM r JOIN e ON e.seg_id = r.seg_id AND e.a = r.px AND e.b > r.root),
lab AS (SELECT seg_id, px // 64 AS y, px % 64 AS x, min(root) AS label FROM r GROUP BY seg_id, px)
"""
# a path to a larger pixel through smaller ones is found from the least pixel, whose component has none smaller
_FOUR = "abs(a.y - b.y) + abs(a.x - b.x) = 1"
_EIGHT = "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"
_DARK = ", ink AS (SELECT seg_id, y, x FROM prob WHERE p > 0.75)\n"


def _labelled(t, eight: bool = False):
    return graph.label_components(t.prob.where("p > 0.75"), 64, eight=eight, block=16)


@query(_DARK + _LABELS.format(near=_FOUR) + "SELECT seg_id, cast(y AS int) AS y, cast(x AS int) AS x, cast(label AS bigint) AS label FROM lab", uses="prob", recursive=True)
def w15_components_4(t):
    return _labelled(t)


@query(", ink AS (SELECT seg_id, y, x FROM prob WHERE p > 0.85)\n" + _LABELS.format(near=_EIGHT) + "SELECT seg_id, cast(y AS int) AS y, cast(x AS int) AS x, cast(label AS bigint) AS label FROM lab", uses="prob", recursive=True)
def w15_components_8(t):
    return graph.label_components(t.prob.where("p > 0.85"), 64, eight=True, block=16)


@query(_DARK + _LABELS.format(near=_FOUR) + "SELECT seg_id, cast(y AS int) AS y, cast(x AS int) AS x FROM lab WHERE (seg_id, label) IN (SELECT (seg_id, label) FROM lab GROUP BY seg_id, label HAVING count(*) >= 4)", uses="prob", recursive=True)
def w16_small_objects_removed(t):
    return graph.remove_small(_labelled(t), 4).select("seg_id", "y", "x")


@query(_DARK + _LABELS.format(near=_FOUR) + "SELECT seg_id, cast(y AS int) AS y, cast(x AS int) AS x FROM lab WHERE (seg_id, label) IN (SELECT (seg_id, label) FROM lab GROUP BY seg_id, label HAVING count(*) >= 4)", uses="prob", recursive=True)
def w16_block_small_objects_removed(t):
    return _ones(block_stencil.remove_small(_map_blocks(t), _BLOCK, 0.75, 4))


@query(_DARK + _LABELS.format(near=_FOUR) + """SELECT l.seg_id, cast(label AS bigint) AS label, count(*) AS area, cast(min(l.y) AS int) AS y0, cast(min(l.x) AS int) AS x0, cast(max(l.y) + 1 AS int) AS y1, cast(max(l.x) + 1 AS int) AS x1,
round(avg(l.y), 6) AS cy, round(avg(l.x), 6) AS cx, round(avg(p.p), 6) AS mean_prob FROM lab l JOIN prob p ON p.seg_id = l.seg_id AND p.y = l.y AND p.x = l.x GROUP BY ALL""", uses="prob", recursive=True)
def a16_j7_component_properties(t):
    c = graph.component_properties(_labelled(t), t.prob)
    return c.withColumns({k: R(k) for k in ("cy", "cx", "mean_prob")})


@query(", ink AS (SELECT seg_id, y, x FROM prob WHERE p > 0.5)\n" + _LABELS.format(near=_FOUR) + """, n AS (SELECT a.seg_id, a.label, count(*) AS v,
 count(*) FILTER (EXISTS (SELECT 1 FROM lab b WHERE b.seg_id = a.seg_id AND b.y = a.y AND b.x = a.x + 1)) AS h,
 count(*) FILTER (EXISTS (SELECT 1 FROM lab b WHERE b.seg_id = a.seg_id AND b.y = a.y + 1 AND b.x = a.x)) AS w,
 count(*) FILTER (EXISTS (SELECT 1 FROM lab b WHERE b.seg_id = a.seg_id AND b.y = a.y AND b.x = a.x + 1) AND EXISTS (SELECT 1 FROM lab b WHERE b.seg_id = a.seg_id AND b.y = a.y + 1 AND b.x = a.x) AND EXISTS (SELECT 1 FROM lab b WHERE b.seg_id = a.seg_id AND b.y = a.y + 1 AND b.x = a.x + 1)) AS q
FROM lab a GROUP BY ALL)
SELECT seg_id, cast(label AS bigint) AS label, v - h - w + q AS euler, greatest(0, 1 - (v - h - w + q)) AS holes FROM n""", uses="prob", recursive=True)
def w17_hole_counts(t):
    return graph.hole_counts(graph.label_components(t.prob.where("p > 0.5"), 64, block=16))


_RUNS = """, prof AS (SELECT seg_id, y, count(*) FILTER (p > 0.93) AS ink FROM prob GROUP BY seg_id, y),
runs AS (SELECT seg_id, min(y) AS a, max(y) + 1 AS z FROM (SELECT *, y - row_number() OVER (PARTITION BY seg_id ORDER BY y) AS run FROM prof WHERE ink > 2) GROUP BY seg_id, run)
SELECT seg_id, greatest(0, a - 1) AS y0, least(64, z + 1) AS y1 FROM runs WHERE z - a >= 2 AND z < 64"""


@query(_RUNS, uses="prob")
def w13_row_bands(t):
    from ..operators import lines

    prof = reduce.row_profile(t.prob, 0.93).select("seg_id", "y", F.greatest(F.col("ink") - 2, F.lit(0)).alias("ink"))
    height = t.prob.select("seg_id").distinct().withColumn("h", F.lit(64))
    return lines.row_bands(prof, height, least=2, pad=1)


_TILES = """, tl AS (SELECT cast(ty * 16 AS int) AS ty, cast(tx * 16 AS int) AS tx FROM range(3) a(ty), range(3) b(tx)),
tp AS (SELECT g.seg_id, g.y, g.x, g.p, tl.ty, tl.tx FROM grid g, tl WHERE g.y >= tl.ty AND g.y < tl.ty + 28 AND g.x >= tl.tx AND g.x < tl.tx + 28)
"""


@query(_GRID + _TILES + "SELECT seg_id, ty, tx, count(*) AS n, round(avg(p), 6) AS mean FROM tp GROUP BY ALL", uses="prob")
def j2_tile_pixels(t):
    tp = tiles.tile_pixels(_grid(t), 28, 16)
    return tp.groupBy("seg_id", "ty", "tx").agg(F.count("*").alias("n"), R(F.avg("p")).alias("mean"))


@query(_GRID + _TILES + "SELECT seg_id, ty, tx, round(avg(CASE WHEN p > 0.5 THEN 1 ELSE 0 END), 6) AS share FROM tp GROUP BY ALL HAVING avg(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) >= 0.25", uses="prob")
def p11_admitted_tiles(t):
    return tiles.admitted_tiles(tiles.tile_pixels(_grid(t), 28, 16), F.col("p") > 0.5, 0.25).withColumn("share", R("share"))


@query(_GRID + _TILES + """, m AS (SELECT seg_id, ty, tx, avg(p) AS q FROM tp GROUP BY ALL), o AS (SELECT tp.seg_id, tp.y, tp.x, avg(m.q) AS q FROM tp JOIN m USING (seg_id, ty, tx) GROUP BY ALL)
SELECT g.seg_id, g.y, g.x, round(CASE WHEN g.p > 0.2 THEN coalesce(o.q, 0) ELSE 0 END, 6) AS p FROM grid g LEFT JOIN o USING (seg_id, y, x)""", uses="prob")
def a21_overlap_average(t):
    g = _grid(t)
    tp = tiles.tile_pixels(g, 28, 16)
    mean = tp.groupBy("seg_id", "ty", "tx").agg(F.avg("p").alias("q"))
    predicted = tp.join(mean, ["seg_id", "ty", "tx"]).select("seg_id", "y", "x", F.col("q").alias("p"))
    marked = g.select("seg_id", "y", "x", (F.col("p") > 0.2).alias("mask"))
    return tiles.overlap_average(marked, predicted, F.col("mask")).withColumn("p", R("p"))


@query(_GRID + _TILES + """, m AS (SELECT seg_id, ty, tx, avg(p) AS q FROM tp GROUP BY ALL),
o AS (SELECT tp.seg_id, tp.y, tp.x, sum(m.q * w) / sum(w) AS q FROM (SELECT *, 1 + least(least(y - ty, 27 - y + ty), least(x - tx, 27 - x + tx)) AS w FROM tp) tp JOIN m USING (seg_id, ty, tx) GROUP BY ALL)
SELECT g.seg_id, g.y, g.x, round(coalesce(o.q, 0), 6) AS p FROM grid g LEFT JOIN o USING (seg_id, y, x)""", uses="prob")
def a21_weighted_average(t):
    """Predictions of overlapping tiles, weighted by the distance from the tile's border."""
    g = _grid(t)
    tp = tiles.tile_pixels(g, 28, 16)
    mean = tp.groupBy("seg_id", "ty", "tx").agg(F.avg("p").alias("q"))
    inside = lambda c, o: F.least(F.col(c) - F.col(o), 27 - F.col(c) + F.col(o))
    weight = 1.0 + F.least(inside("y", "ty"), inside("x", "tx"))
    predicted = tp.join(mean, ["seg_id", "ty", "tx"]).select("seg_id", "y", "x", F.col("q").alias("p"), weight.alias("weight"))
    return tiles.overlap_average(g.select("seg_id", "y", "x"), predicted).withColumn("p", R("p"))


@query()
def m1_segment_network(t):
    """The network for segments, with weights drawn by a seed, over tiles of the volumes."""
    vox = t.voxels.select("seg_id", "z", "y", "x", "v")
    cells = vox.select("seg_id").distinct()
    for axis, n in (("z", 6), ("y", 63), ("x", 63)):
        cells = cells.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n))))
    full = cells.join(vox, ["seg_id", "z", "y", "x"], "left").select("seg_id", "z", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))
    return tiles.predict_segment(full, networks.segment_network(networks.drawn_weights(0)), 24, 20).withColumn("p", R("p", 4))


def _mean_model():
    """Stands in for a network: the mean over the layers."""
    return lambda x: (x * 255.0).round().astype("float64").mean(axis=1) / 255.0


@query("""SELECT seg_id, y, x, round(CASE WHEN mask AND y < 56 AND x < 56 THEN s / 7 / 255 ELSE 0 END, 5) AS p
FROM (SELECT seg_id, y, x, max(v) > 0 AS mask, cast(sum(v) AS double) AS s FROM full_voxels GROUP BY seg_id, y, x)""".replace("full_voxels", "(SELECT c.seg_id, c.z, c.y, c.x, coalesce(v.v, 0) AS v FROM (SELECT seg_id, cast(z AS int) AS z, cast(y AS int) AS y, cast(x AS int) AS x FROM (SELECT DISTINCT seg_id FROM voxels), range(7) a(z), range(64) b(y), range(64) d(x)) c LEFT JOIN voxels v ON v.seg_id = c.seg_id AND v.z = c.z AND v.y = c.y AND v.x = c.x)"), uses="voxels")
def x5_t1_tiled_inference(t):
    cells = t.voxels.select("seg_id").distinct()
    for axis, n in (("z", 6), ("y", 63), ("x", 63)):
        cells = cells.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n))))
    vox = cells.join(t.voxels, ["seg_id", "z", "y", "x"], "left").select("seg_id", "z", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))
    # tiles of 24 at 0, 16 and 32: what lies from 56 on is not covered
    return tiles.predict_segment(vox, _mean_model, 24, 16).withColumn("p", R("p", 5))


@query("""SELECT seg_id, y, x, round(sum(v) / cast(7 AS double) / 255, 4) AS p FROM voxels WHERE y < 56 AND x < 56
GROUP BY seg_id, y, x HAVING round(sum(v) / cast(7 AS double) / 255, 4) > 0""", uses="voxels")
def x5_x6_block_inference(t):
    """Volumes are written as block rows; what is read from them is predicted tile by tile. Cells that are 0 have no row."""
    path = work_path(t.spark, "blocks")
    # the corner tells how far each volume reaches, and that it has 7 layers
    ends = t.voxels.select("seg_id").distinct().select("seg_id", F.explode(F.array(F.lit(0), F.lit(6))).alias("z"), F.lit(63).alias("y"), F.lit(63).alias("x"), F.lit(0).alias("v"))
    vox = t.voxels.select("seg_id", "z", "y", "x", "v").unionByName(ends).groupBy("seg_id", "z", "y", "x").agg(F.max("v").alias("v"))
    blocks.write_blocks(blocks.to_blocks(vox, 16), path)
    p = block_tiles.predict_blocks(blocks.read_blocks(t.spark, path), _mean_model, 24, 16, 16)
    return block_tiles.map_pixels(p, 16).withColumn("p", R("p", 4)).where("p > 0")


@query("SELECT seg_id, y // 8 AS wy, x // 8 AS wx, y % 8 AS iy, x % 8 AS ix, p FROM prob", uses="prob")
def f28_window_partition(t):
    return tiles.window_partition(t.prob, 8).drop("y", "x")


@query(_GRID + """, c AS (SELECT s.seg_id, cast(y AS int) AS y, cast(x AS int) AS x FROM (SELECT DISTINCT seg_id FROM prob) s, range(70) a(y), range(70) b(x)),
w AS (SELECT c.seg_id, c.y, c.x, coalesce(g.p, 0) AS p, c.y // 7 AS wy, c.x // 7 AS wx FROM c LEFT JOIN grid g USING (seg_id, y, x))
SELECT seg_id, y, x, round(p - avg(p) OVER (PARTITION BY seg_id, wy, wx), 6) + 0.0 AS p FROM w WHERE y < 70""", uses="prob")
def f28_window_round_trip(t):
    """A map that isn't a whole number of windows: padded, cut into windows, each less its mean, and put together again."""
    w = tiles.window_partition(tiles.padded(_grid(t), 7), 7)
    mean = w.groupBy("seg_id", "wy", "wx").agg(F.avg("p").alias("mean"))
    changed = w.drop("y", "x").join(mean, ["seg_id", "wy", "wx"]).withColumn("p", F.col("p") - F.col("mean")).drop("mean")
    return tiles.window_merge(changed, 7).select("seg_id", "y", "x", (R("p") + 0.0).alias("p"))


@query(""", e AS (SELECT seg_id, max(y) + 1 AS h, max(x) + 1 AS w FROM prob GROUP BY seg_id)
SELECT seg_id, cast(w - 1 - x AS int) AS y, cast(h - 1 - y AS int) AS x, p FROM prob JOIN e USING (seg_id)""", uses="prob")
def f14_orientations(t):
    """Upside down, then a quarter turn: (y, x) becomes (W - 1 - x, H - 1 - y)."""
    return tiles.oriented(t.prob, flip_y=True, turns=1)


@query("SELECT seg_id, y, x, round(p, 6) AS p FROM prob", uses="prob")
def m7_orientation_average(t):
    """A model that looks at single pixels gives the same from all eight sides."""
    return tiles.orientation_average(t.prob, lambda d: d).withColumn("p", R("p"))


@query("""SELECT a.seg_id, a.z, a.y, a.x, coalesce(b.v, 0) AS v FROM voxels a LEFT JOIN voxels b ON b.seg_id = a.seg_id AND b.z = a.z - CASE a.seg_id WHEN 'A' THEN 1 WHEN 'N' THEN -2 ELSE 0 END AND b.y = a.y AND b.x = a.x""", uses="voxels")
def f15_moved_layers(t):
    step = F.when(F.col("seg_id") == "A", 1).when(F.col("seg_id") == "N", -2).otherwise(0)
    return augment.moved_layers(t.voxels.select("seg_id", "z", "y", "x", "v"), ["seg_id"], step).withColumn("v", F.col("v").cast("long"))


@query("""SELECT p.seg_id, p.y, p.x, p.p, l.t, n.p AS next_p FROM prob p JOIN labels_map l USING (seg_id, y, x) JOIN prob_next n USING (seg_id, y, x)""", uses="prob labels_map prob_next")
def j1_pixel_alignment(t):
    key = ["seg_id", "y", "x"]
    return t.prob.join(t.labels_map, key).join(t.prob_next.withColumnRenamed("p", "next_p"), key)


_DRAW = "cast('0x' || substr(md5({0}), 1, 8) AS bigint) % {1}"
_MARKED = _GRID + """, marked AS (SELECT g.seg_id, g.y, g.x, g.p > 0 AS mask, coalesce(l.t, 0) AS label FROM grid g LEFT JOIN labels_map l USING (seg_id, y, x))
"""


def _marked(t):
    return _grid(t).join(t.labels_map, ["seg_id", "y", "x"], "left").select("seg_id", "y", "x", (F.col("p") > 0).alias("mask"), F.coalesce("t", F.lit(0.0)).alias("label"))


@query(_MARKED + """, tl AS (SELECT cast(a * 8 AS int) AS ty, cast(b * 8 AS int) AS tx FROM range(7) r(a), range(7) s(b)),
g AS (SELECT m.seg_id, ty, tx, avg(CASE WHEN mask THEN 1 ELSE 0 END) AS share, avg(label) AS label FROM marked m JOIN tl ON m.y >= ty AND m.y < ty + 16 AND m.x >= tx AND m.x < tx + 16 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY """ + _DRAW.format("seg_id || ':' || ty || ':' || tx || ':0'", "4294967296") + """, ty, tx) AS rank FROM g
  WHERE share >= 0.01 AND (label >= 0.005 OR """ + _DRAW.format("seg_id || ':' || ty || ':' || tx || ':1'", "2") + """ = 0))
SELECT seg_id, ty, tx, round(share, 6) AS share, round(label, 6) AS label, cast(rank AS int) AS rank FROM k WHERE rank <= 10""", uses="prob labels_map")
def o6_sampled_tiles(t):
    s = tiles.sampled_tiles(tiles.tile_pixels(_marked(t), 16, 8), 10, mask=F.col("mask"), label=F.col("label"), least_mask=0.01, ink=0.005)
    return s.withColumns({"share": R("share"), "label": R("label")})


@query(_MARKED + """, a AS (SELECT seg_id, n AS sample, k AS attempt, """ + _DRAW.format("seg_id || ':' || n || ':' || k || ':y:0'", "49") + " AS y, " + _DRAW.format("seg_id || ':' || n || ':' || k || ':x:0'", "49") + """ AS x
  FROM (SELECT DISTINCT seg_id FROM marked), range(6) r(n), range(8) s(k)),
g AS (SELECT a.seg_id, a.sample, a.attempt, a.y, a.x, avg(CASE WHEN mask THEN 1 ELSE 0 END) AS share, avg(label) AS label FROM a JOIN marked m ON m.seg_id = a.seg_id AND m.y >= a.y AND m.y < a.y + 16 AND m.x >= a.x AND m.x < a.x + 16 GROUP BY ALL),
f AS (SELECT *, share >= 0.05 AND (label >= 0.02 OR """ + _DRAW.format("seg_id || ':' || sample || ':' || attempt || ':coin:0'", "2") + """ = 0) AS good FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY seg_id, sample ORDER BY good DESC, CASE WHEN good THEN attempt ELSE -attempt END) AS n FROM f)
SELECT seg_id, cast(sample AS int) AS sample, cast(attempt AS int) AS attempt, cast(y AS int) AS y, cast(x AS int) AS x, round(share, 6) AS share, round(label, 6) AS label FROM k WHERE n = 1""", uses="prob labels_map")
def t2_sampled_patches(t):
    s = tiles.sampled_patches(_marked(t), 6, 16, tries=8, least_mask=0.05, ink=0.02)
    return s.withColumns({"share": R("share"), "label": R("label")})


@query("SELECT seg_id, count(*) FILTER (sup) AS n FROM (SELECT seg_id, t < 0.4 OR t > 0.6 AS sup FROM labels_map WHERE seg_id <> 'A') GROUP BY seg_id", uses="labels_map")
def u1_leave_one_out(t):
    held = t.labels_map.where("seg_id = 'A'").select("seg_id").distinct()
    train = t.labels_map.join(held, "seg_id", "left_anti")
    return train.groupBy("seg_id").agg(F.count_if(metrics.supervised(F.col("t"))).alias("n"))


@query("""SELECT p, count(*) AS n FROM (SELECT round(p, 2) AS p FROM prob UNION ALL SELECT round(p, 2) FROM prob_next) GROUP BY p""", uses="prob prob_next")
def u2_union_of_patches(t):
    every = t.prob.select(R("p", 2).alias("p")).unionAll(t.prob_next.select(R("p", 2).alias("p")))
    return every.groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT seg_id FROM (VALUES ('A'), ('Q'), ('N'), ('Z')) v(seg_id) EXCEPT SELECT seg_id FROM manifest", uses="manifest")
def u4_unknown_ids(t):
    asked = t.spark.createDataFrame([("A",), ("Q",), ("N",), ("Z",)], "seg_id string")
    return asked.exceptAll(asked.join(t.manifest.select("seg_id").distinct(), "seg_id")).distinct()


@query("SELECT seg_id, cast(z AS int) AS z FROM (SELECT DISTINCT seg_id FROM manifest), range(9) r(z) WHERE (seg_id, z) NOT IN (SELECT (seg_id, z) FROM manifest WHERE n_px > 0)", uses="manifest")
def u5_layers_to_fetch(t):
    want = t.manifest.select("seg_id").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return want.join(t.manifest.where("n_px > 0"), ["seg_id", "z"], "left_anti")


@query("SELECT seg_id, 'https://host/' || seg_id || '/layers/' || lpad(cast(z AS varchar), 2, '0') || '.tif' AS url FROM manifest", uses="manifest")
def f22_layer_addresses(t):
    from ..sources.raster import layer_url

    return t.manifest.select("seg_id", layer_url("https://host/%s/layers/%s.tif", F.col("seg_id"), F.col("z")).alias("url"))


@query("SELECT seg_id, round(sum(n_px) / 1e9, 9) AS gb, round(sum(n_px) / 1073741824, 9) AS gib FROM manifest GROUP BY seg_id", uses="manifest")
def f27_sizes(t):
    return t.manifest.groupBy("seg_id").agg(R(S.gigabytes(F.sum("n_px")), 9).alias("gb"), R(S.gigabytes(F.sum("n_px"), binary=True), 9).alias("gib"))


@query(_GRID + """, tl AS (SELECT cast(a * 16 AS int) AS ty, cast(b * 16 AS int) AS tx FROM range(3) r(a), range(3) s(b))
SELECT g.seg_id, ty, tx, count(*) AS n, round(sum(g.p), 3) AS total FROM grid g JOIN tl ON g.y >= ty AND g.y < ty + 28 AND g.x >= tx AND g.x < tx + 28 GROUP BY ALL""", uses="prob")
def x6_patch_rows(t):
    """One row for each patch, its values in order."""
    p = tiles.patch_rows(_grid(t).select("seg_id", F.lit(0).alias("z"), "y", "x", F.col("p").alias("v")), 28, 16)
    return p.select("seg_id", "ty", "tx", F.size("img").cast("long").alias("n"), R(F.aggregate("img", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("""SELECT v.seg_id, ty, tx, cast(count(*) AS bigint) AS n, round(sum(coalesce(p.v, 0) / cast(255 AS double)), 3) AS total
FROM (SELECT s.seg_id, z, y, x, ty * 16 AS ty, tx * 16 AS tx FROM (SELECT DISTINCT seg_id FROM voxels) s, range(7) k(z), range(3) a(ty), range(3) b(tx), range(64) c(y), range(64) d(x)
  WHERE y >= ty * 16 AND y < ty * 16 + 28 AND x >= tx * 16 AND x < tx * 16 + 28) v LEFT JOIN voxels p ON p.seg_id = v.seg_id AND p.z = v.z AND p.y = v.y AND p.x = v.x GROUP BY ALL""", uses="voxels")
def x6_patch_function(t):
    """Patches of all layers by a table function, over the pieces of tiles that block rows are cut to."""
    block_tiles.register_functions(t.spark)
    ends = t.voxels.select("seg_id").distinct().select("seg_id", F.explode(F.array(F.lit(0), F.lit(6))).alias("z"), F.lit(63).alias("y"), F.lit(63).alias("x"), F.lit(0).alias("v"))
    vox = t.voxels.select("seg_id", "z", "y", "x", "v").unionByName(ends).groupBy("seg_id", "z", "y", "x").agg(F.max("v").alias("v"))
    pieces = block_tiles.tile_pieces(blocks.to_blocks(vox, 16), 28, 16, 16)
    return t.spark.sql("""SELECT seg_id, ty, tx, cast(size(img) AS bigint) AS n, round(aggregate(img, 0D, (a, v) -> a + v), 3) AS total
FROM patch_rows(TABLE({pieces}) PARTITION BY (seg_id, ty, tx), 28)""", pieces=pieces)


@query("SELECT seg_id, z, y, x, v FROM voxels WHERE seg_id <> 'N' AND z >= 2 AND z < 6 AND v > 0", uses="voxels")
def s1_t6_layer_source(t):
    """Layers are written as files, and some of them read by the layer source, in ranges of rows; conditions choose the files."""
    path = work_path(t.spark, "layers")
    layers.write_layers(t.voxels, path).write.format("noop").mode("overwrite").save()
    return layers.read_layers(t.spark, path, rangeBytes=1500).where("seg_id in ('A', 'R') and z >= 2 and z < 6 and v > 0")


_SURFACE = """, e AS (SELECT seg_id, max(z) + 1 AS d, max(y) + 1 AS h, max(x) + 1 AS w, quantile_cont(v, 0.5) AS level FROM voxels GROUP BY seg_id),
g AS (SELECT e.*, cast(a.z AS int) AS z, cast(b.y AS int) AS y, cast(c.x AS int) AS x, coalesce(v.v, 0) AS v, CASE WHEN coalesce(v.v, 0) > level THEN 1 ELSE 0 END AS s
 FROM e JOIN range(7) a(z) ON a.z < d JOIN range(64) b(y) ON b.y < h JOIN range(64) c(x) ON c.x < w LEFT JOIN voxels v ON v.seg_id = e.seg_id AND v.z = a.z AND v.y = b.y AND v.x = c.x),
cut AS (SELECT p.seg_id, p.z + n.z * t AS z, p.y + n.y * t AS y, p.x + n.x * t AS x FROM (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) n(z, y, x), g p JOIN g q ON q.seg_id = p.seg_id AND q.s <> p.s AND q.z = p.z + n.z AND q.y = p.y + n.y AND q.x = p.x + n.x,
 LATERAL (SELECT (p.level - p.v) / cast(q.v - p.v AS double) AS t)),
vx AS (SELECT seg_id, count(*) AS n_vertices, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM cut GROUP BY seg_id),
corner AS (SELECT cs, i, (cs >> i) & 1 AS s FROM range(256) a(cs), range(8) b(i)),
near AS (SELECT p.cs, p.i AS p, q.i AS q, p.s <> q.s AS crossed FROM corner p JOIN corner q ON q.cs = p.cs AND xor(p.i, q.i) IN (1, 2, 4)),
over AS (SELECT p.cs, p.i AS p, q.i AS q FROM corner p JOIN corner q ON q.cs = p.cs AND p.s = 0 AND q.s = 0 AND xor(p.i, q.i) IN (3, 5, 6)
 WHERE (SELECT min(o.s) FROM corner o WHERE o.cs = p.cs AND o.i <> p.i AND o.i <> q.i AND o.i & (7 - xor(p.i, q.i)) = p.i & (7 - xor(p.i, q.i))) = 1),
reach AS (SELECT cs, i AS p, i AS q FROM corner UNION SELECT r.cs, r.p, n.q FROM reach r JOIN (SELECT cs, p, q FROM near WHERE NOT crossed UNION ALL SELECT * FROM over) n ON n.cs = r.cs AND n.p = r.q),
kind AS (SELECT cs, parts - 1 AS loops, cuts FROM (SELECT cs, count(DISTINCT least) AS parts FROM (SELECT cs, p, min(q) AS least FROM reach GROUP BY cs, p) GROUP BY cs) JOIN (SELECT cs, count(*) FILTER (crossed) // 2 AS cuts FROM near GROUP BY cs) USING (cs)),
cube AS (SELECT seg_id, sum(s << i) AS cs FROM (SELECT *, z - (i & 1) AS cz, y - ((i >> 1) & 1) AS cy, x - ((i >> 2) & 1) AS cx FROM g, range(8) b(i)) WHERE cz BETWEEN 0 AND d - 2 AND cy BETWEEN 0 AND h - 2 AND cx BETWEEN 0 AND w - 2 GROUP BY seg_id, cz, cy, cx),
inner_parts AS (SELECT seg_id, sum(cuts - 2 * loops) AS n_faces, sum(cuts - 3 * loops) AS within FROM cube JOIN kind USING (cs) GROUP BY seg_id),
square AS (SELECT seg_id, max(s) FILTER (i = 0) AS s0, max(s) FILTER (i = 1) AS s1, max(s) FILTER (i = 2) AS s2, max(s) FILTER (i = 3) AS s3 FROM (
 SELECT *, z - CASE n WHEN 0 THEN 0 ELSE i & 1 END AS cz, y - CASE n WHEN 0 THEN i & 1 WHEN 1 THEN 0 ELSE i >> 1 END AS cy, x - CASE n WHEN 2 THEN 0 ELSE i >> 1 END AS cx FROM g, range(4) b(i), range(3) c(n))
 WHERE cz >= 0 AND cy >= 0 AND cx >= 0 AND cz <= d - 1 - cast(n <> 0 AS int) AND cy <= h - 1 - cast(n <> 1 AS int) AND cx <= w - 1 - cast(n <> 2 AS int) GROUP BY seg_id, n, cz, cy, cx),
lined AS (SELECT seg_id, sum((cast(s0 <> s1 AS int) + cast(s1 <> s3 AS int) + cast(s3 <> s2 AS int) + cast(s2 <> s0 AS int)) // 2) AS lines FROM square GROUP BY seg_id)
"""


@query(_SURFACE + """SELECT seg_id, round(level, 6) AS level, n_vertices, cast(within + lines AS bigint) AS n_edges, cast(n_faces AS bigint) AS n_faces, cast(2 * (within + lines) - 3 * n_faces AS bigint) AS n_open,
cast(n_vertices - within - lines + n_faces AS bigint) AS euler, z, y, x FROM vx JOIN inner_parts USING (seg_id) JOIN lined USING (seg_id) JOIN e USING (seg_id)""", uses="voxels", recursive=True)
def f30_isosurface(t):
    """The surface at each segment's median by marching cubes on bricks: its parts, and the mean place of its vertices."""
    levels = written(reduce.exact_percentiles(t.voxels, "v", {"level": 0.5}).select("seg_id", "level"), "levels")
    b = written(isosurface.bricks(blocks.to_blocks(t.voxels, 16), 16, 4), "bricks")
    v = isosurface.vertices(b, levels)
    mean = v.groupBy("seg_id").agg(*(R(F.avg(c)).alias(c) for c in "zyx"))
    s = isosurface.surface_summary(v, isosurface.faces(b, levels))
    return s.join(mean, "seg_id").join(levels, "seg_id").withColumn("level", R("level"))
