"""Isosurfaces of volumes by marching cubes on block rows.

A brick is some layers of one block with one more layer, row and column from the bricks behind it, which those send. Every
edge of the grid belongs to the brick that holds its lower corner, and its number is that corner's place, so that vertices
are welded across bricks without a shuffle: the brick that owns an edge gives the vertex, all others only name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_stencil import _rows

_KEY = ["seg_id", "bz", "by", "bx"]
_PIECE = "seg_id string, bz int, by int, bx int, z int, y int, x int, h int, w int, data binary"
BRICK_SCHEMA = "seg_id string, bz int, by int, bx int, z0 int, y0 int, x0 int, d int, h int, w int, depth int, size int, data binary"
VERTEX_SCHEMA = "seg_id string, vertex long, z double, y double, x double"
FACE_SCHEMA = "seg_id string, a long, b long, c long"
_BITS = 20


def bricks(blocks: DataFrame, size: int, depth: int = 16) -> DataFrame:
    """Bricks of `depth` layers of the block rows (of to_blocks, cells size x size). A segment reaches from 0 to its last layer, row
    and column; cells without a value are 0. Coordinates must be below 2^20. Of two blocks of one place one is taken."""
    ext = blocks.groupBy("seg_id").agg((F.max("z") + 1).alias("_d"), F.max(F.col("by") * size + F.col("h")).alias("_h"), F.max(F.col("bx") * size + F.col("w")).alias("_w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                img, (bz, z), rows = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"]), divmod(r["z"], depth), []
                for k in range(1 + (z == 0 and bz > 0)):
                    for j in range(1 + (r["by"] > 0)):
                        for i in range(1 + (r["bx"] > 0)):
                            # the bricks before this block see its first layer, row and column behind their own
                            part = img[: 1 if j else None, : 1 if i else None]
                            rows.append((r["seg_id"], bz - k, r["by"] - j, r["bx"] - i, z + k * depth, j * size, i * size, *part.shape, part.tobytes()))
                yield from _rows(rows, _PIECE).to_batches()

    def build(key: tuple, table: pa.Table) -> pa.Table:
        seg_id, bz, by, bx = (k.as_py() for k in key)
        rows = table.to_pylist()
        place = (bz * depth, by * size, bx * size)
        shape = tuple(min(n + 1, rows[0][c] - at) for n, c, at in zip((depth, size, size), ("_d", "_h", "_w"), place, strict=True))
        vol = np.zeros(shape, np.uint8)
        for r in rows:
            part = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"])
            vol[r["z"], r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = part
        return _rows([(seg_id, bz, by, bx, *place, *shape, depth, size, vol.tobytes())], BRICK_SCHEMA)

    pieces = blocks.select("seg_id", "z", "by", "bx", "h", "w", "data").mapInArrow(cut, _PIECE)
    return pieces.join(ext, "seg_id").groupBy(*_KEY).applyInArrow(build, BRICK_SCHEMA)


def case_triangles() -> np.ndarray:
    """Triangles of each of the 256 cases of a cube as (case, triangle, corner) -> edge, -1 behind the last.

    Bit i of a case says that corner i lies inside; bit a of i is its offset along axis a. Edge 4 * a + k goes along axis a
    from the k-th corner without bit a. The table follows from a rule: around each face, seen from outside, every run of inside
    corners is cut off by a line from where it begins to where it ends (so inside corners across a face stay apart);
    a cut edge begins a run on one of its faces and ends one on the other, so lines join to loops, and a loop is a fan.
    """
    lower = [[i for i in range(8) if not i >> a & 1] for a in range(3)]
    edge_of = {frozenset((i, i | 1 << a)): 4 * a + k for a in range(3) for k, i in enumerate(lower[a])}
    faces = []
    for n in range(3):
        u, v = 1 << (n + 1) % 3, 1 << (n + 2) % 3
        around = [0, u, u | v, v]
        faces += [[i | 1 << n for i in around], around[::-1]]
    found: list[list[tuple[int, int, int]]] = []
    for case in range(256):
        inside = [bool(case >> i & 1) for i in range(8)]
        line: dict[int, int] = {}
        for face in faces:
            cuts = [(edge_of[frozenset((face[j], face[(j + 1) % 4]))], inside[face[(j + 1) % 4]]) for j in range(4) if inside[face[j]] != inside[face[(j + 1) % 4]]]
            for j, (edge, begins) in enumerate(cuts):
                if begins:
                    line[edge] = cuts[(j + 1) % len(cuts)][0]
        triangles = []
        while line:
            first, at = line.popitem()
            loop = [first]
            while at != first:
                loop.append(at)
                at = line.pop(at)
            triangles += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
        found.append(triangles)
    table = np.full((256, max(map(len, found)), 3), -1, np.int8)
    for case, triangles in enumerate(found):
        if triangles:
            table[case, : len(triangles)] = triangles
    return table


def _number(z, y, x, axis) -> np.ndarray:
    """An edge's number: the place of its lower corner and its axis."""
    return (((z << _BITS | y) << _BITS | x) << 2) | axis


def _volume(r: dict) -> tuple[np.ndarray, tuple[int, int, int], tuple[int, int, int]]:
    """Values, place and own cells (without what the bricks behind lent) of a brick."""
    vol = np.frombuffer(r["data"], np.uint8).reshape(r["d"], r["h"], r["w"])
    return vol, (r["z0"], r["y0"], r["x0"]), (min(r["d"], r["depth"]), min(r["h"], r["size"]), min(r["w"], r["size"]))


def _levelled(bricks: DataFrame, levels: DataFrame) -> DataFrame:
    return bricks.join(levels.select("seg_id", F.col("level").cast("double").alias("level")), "seg_id").where(F.col("level").isNotNull())


def vertices(bricks: DataFrame, levels: DataFrame) -> DataFrame:
    """(seg_id, vertex, z, y, x): where the surface between values above the segment's level and the others cuts the grid's edges, by
    linear interpolation. levels: (seg_id, level); segments without one have no surface, nor have those without thickness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                vol, place, own = _volume(r)
                for axis in range(3):
                    lo = tuple(slice(0, min(n, s - (a == axis))) for a, (n, s) in enumerate(zip(own, vol.shape, strict=True)))
                    hi = tuple(slice(s.start + (a == axis), s.stop + (a == axis)) for a, s in enumerate(lo))
                    at = np.nonzero((vol[lo] > r["level"]) != (vol[hi] > r["level"]))
                    p, q = vol[lo][at].astype(np.float64), vol[hi][at].astype(np.float64)
                    z, y, x = (i + o for i, o in zip(at, place, strict=True))
                    where = [c + (r["level"] - p) / (q - p) if a == axis else c.astype(np.float64) for a, c in enumerate((z, y, x))]
                    yield pa.RecordBatch.from_arrays([pa.array([r["seg_id"]] * len(p), pa.string()), pa.array(_number(z, y, x, axis), pa.int64()), *map(pa.array, where)], names=["seg_id", "vertex", "z", "y", "x"])

    return _thick(_levelled(bricks, levels)).mapInArrow(run, VERTEX_SCHEMA)


def faces(bricks: DataFrame, levels: DataFrame) -> DataFrame:
    """(seg_id, a, b, c): the surface's triangles by their vertices' numbers, all turned alike."""
    table = case_triangles()
    axis = np.repeat(np.arange(3), 4)
    corner = np.array([i for a in range(3) for i in range(8) if not i >> a & 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                vol, place, _ = _volume(r)
                inside = (vol > r["level"]).astype(np.uint8)
                d, h, w = (n - 1 for n in vol.shape)
                case = np.zeros((d, h, w), np.uint8)
                for i in range(8):
                    z, y, x = i & 1, i >> 1 & 1, i >> 2 & 1
                    case |= inside[z : z + d, y : y + h, x : x + w] << i
                at = np.nonzero((case > 0) & (case < 255))
                edges = table[case[at]]
                cube, t = np.nonzero(edges[:, :, 0] >= 0)
                e = edges[cube, t].astype(np.int64)
                z, y, x = ((i + o)[cube, None] + (corner[e] >> a & 1) for a, (i, o) in enumerate(zip(at, place, strict=True)))
                number = _number(z, y, x, axis[e])
                yield pa.RecordBatch.from_arrays([pa.array([r["seg_id"]] * len(e), pa.string()), *(pa.array(number[:, k], pa.int64()) for k in range(3))], names=["seg_id", "a", "b", "c"])

    return _thick(_levelled(bricks, levels)).mapInArrow(run, FACE_SCHEMA)


def _thick(levelled: DataFrame) -> DataFrame:
    """Without segments that are one cell high, wide or deep: no cube lies in them. Their bricks at place 0 show it."""
    flat = lambda o, n: (F.col(o) == 0) & (F.col(n) == 1)
    return levelled.where(~(flat("z0", "d") | flat("y0", "h") | flat("x0", "w")))


def surface_summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(seg_id, n_vertices, n_edges, n_faces, n_open, euler): n_open edges, on the volume's border, have one triangle. Edges are counted
    by their triangles, so that two sheets which touch along an edge count it twice."""
    side = F.explode(F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), F.when(F.col(p) < F.col(q), 1).otherwise(-1).alias("way")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    sides = faces.select("seg_id", side.alias("s")).groupBy("seg_id", "s.p", "s.q").agg(F.count("*").alias("n"), F.abs(F.sum("s.way")).alias("open"))
    e = sides.groupBy("seg_id").agg(F.sum("n").alias("n"), F.sum("open").alias("n_open"))
    v = vertices.groupBy("seg_id").agg(F.count("*").alias("n_vertices"))
    n_faces, n_edges = (F.col("n") / 3).cast("long"), ((F.col("n") + F.col("n_open")) / 2).cast("long")
    return v.join(e, "seg_id").select("seg_id", "n_vertices", n_edges.alias("n_edges"), n_faces.alias("n_faces"), "n_open", (F.col("n_vertices") - n_edges + n_faces).alias("euler"))
