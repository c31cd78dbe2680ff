"""Marching cubes on bricks: closed and open surfaces, and the same surface whatever the bricks."""

import numpy as np
import pytest

from glyphgrid.operators import isosurface as I
from glyphgrid.sources import blocks


def surface(spark, vol, level, size=8, depth=4, seg="s"):
    cells = [(seg, *map(int, at), int(vol[at])) for at in np.ndindex(vol.shape)]
    vox = spark.createDataFrame(cells, "seg_id string, z int, y int, x int, v int")
    b = I.bricks(blocks.to_blocks(vox, size), size, depth).cache()
    levels = spark.createDataFrame([(seg, level)], "seg_id string, level double")
    return I.vertices(b, levels), I.faces(b, levels)


def summary(spark, vol, level, **given):
    got = I.surface_summary(*surface(spark, vol, level, **given)).collect()
    return got[0].asDict() if got else None


def ball(side, radius):
    z, y, x = np.indices((side,) * 3) - (side - 1) / 2
    return np.clip(200 - 20 * (np.sqrt(z * z + y * y + x * x) - radius), 0, 255).astype(np.uint8)


def test_cases_are_turned_alike_and_closed():
    table = I.case_triangles()
    assert table.shape == (256, 5, 3) and (table[0] == -1).all() and (table[255] == -1).all()
    for case in range(256):
        edges = [tuple(t[[i, (i + 1) % 3]]) for t in table[case] if t[0] >= 0 for i in range(3)]
        assert len(edges) == len(set(edges))  # no side twice in one direction
        cut = {4 * a + k for a in range(3) for k, i in enumerate([i for i in range(8) if not i >> a & 1]) if (case >> i ^ case >> (i | 1 << a)) & 1}
        assert {e for t in table[case] if t[0] >= 0 for e in t} == cut


def test_a_ball_and_a_ring(spark):
    s = summary(spark, ball(13, 4), 199.0)
    assert (s["euler"], s["n_open"]) == (2, 0) and 2 * s["n_edges"] == 3 * s["n_faces"]
    z, y, x = np.indices((7, 17, 17)) - np.array([3, 8, 8])[:, None, None, None]
    ring = np.where((np.sqrt(y * y + x * x) - 5) ** 2 + z * z <= 4, 255, 0).astype(np.uint8)
    s = summary(spark, ring, 127.0)
    assert (s["euler"], s["n_open"]) == (0, 0)


def test_two_balls_are_two_surfaces_and_a_cut_ball_is_open(spark):
    two = np.concatenate([ball(11, 3), ball(11, 3)])
    assert summary(spark, two, 199.0)["euler"] == 4
    half = summary(spark, ball(13, 4)[6:], 199.0)
    assert half["euler"] == 1 and half["n_open"] > 0


@pytest.mark.parametrize(("size", "depth"), [(4, 2), (8, 16), (64, 64)])
def test_bricks_do_not_show(spark, size, depth):
    vol = np.random.default_rng(5).integers(0, 256, (6, 11, 13), dtype=np.uint8)
    v, f = (sorted(map(tuple, d.collect())) for d in surface(spark, vol, 127.5, size, depth))
    want = {}
    for axis in range(3):
        for at in np.ndindex(vol.shape):
            to = tuple(c + (a == axis) for a, c in enumerate(at))
            if to[axis] < vol.shape[axis] and (vol[at] > 127.5) != (vol[to] > 127.5):
                p, q = float(vol[at]), float(vol[to])
                want[((at[0] << 20 | at[1]) << 20 | at[2]) << 2 | axis] = tuple(c + (127.5 - p) / (q - p) * (a == axis) for a, c in enumerate(at))
    assert {(r[1], a): c for r in v for a, c in enumerate(r[2:])} == pytest.approx({(n, a): c for n, at in want.items() for a, c in enumerate(at)}) and len(v) == len(want)
    assert {n for r in f for n in r[1:]} == set(want) and len(f) == len(set(f))
    # each side of a triangle meets another in the other direction, but on the volume's border
    sides = {}
    for _, *t in f:
        for p, q in zip(t, t[1:] + t[:1], strict=True):
            sides[p, q] = sides.get((p, q), 0) + 1
    place = {r[1]: r[2:] for r in v}
    last = [n - 1 for n in vol.shape]
    for (p, q), n in sides.items():
        if sides.get((q, p), 0) != n:
            assert any(place[p][a] == place[q][a] and place[p][a] in (0, last[a]) for a in range(3))


def test_flat_empty_and_unknown(spark):
    assert summary(spark, np.arange(25, dtype=np.uint8).reshape(1, 5, 5), 12.0) is None
    assert summary(spark, np.zeros((4, 4, 4), np.uint8), 12.0) is None
    assert summary(spark, ball(9, 2), None) is None
    # a layer that has no rows is 0
    v, f = surface(spark, ball(9, 2), 199.0)
    empty = spark.createDataFrame([], blocks.SCHEMA)
    levels = spark.createDataFrame([("s", 1.0)], "seg_id string, level double")
    assert I.faces(I.bricks(empty, 8), levels).count() == 0
