"""Neighbourhood operators on the block rows of maps, by halo exchange.

A block sends its border strips to the blocks around it, which put them around their own values; what a stencil needs is then an array
in one task, and what is shuffled is a block and its margins. A chain of stencils takes one exchange, as wide as its radii
together. Arrays that reach the image's own border end there; where they end inside the image, what a stencil gives near their
end is wrong and lies outside the block. Equal to the operators of `stencil` on pixel rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .block_tiles import MAP_SCHEMA
from .graph import components, forest
from .stencil import disk

_KEY = ["seg_id", "by", "bx"]
_PIECE = "seg_id string, by int, bx int, dy int, dx int, h int, w int, data binary"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], _TYPES[kind]) for i, (name, kind) in enumerate(fields)})


def map_blocks(prob: DataFrame, size: int = 256) -> DataFrame:
    """Block rows (MAP_SCHEMA, doubles) of (seg_id, y, x, p); cells without a row are 0. Blocks reach to the segment's last pixel."""
    ext = prob.groupBy("seg_id").agg((F.max("y") + 1).cast("int").alias("_h"), (F.max("x") + 1).cast("int").alias("_w"))
    number = lambda c: F.sequence(F.lit(0), F.floor((F.col(c) - 1) / size).cast("int"))
    every = ext.select("seg_id", F.explode(number("_h")).alias("by"), "_h", "_w").select("seg_id", "by", F.explode(number("_w")).alias("bx"), "_h", "_w")
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    # names of their own, since both sides come from one table
    px = prob.select(F.col("seg_id").alias("_seg"), at("y").alias("_by"), at("x").alias("_bx"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("p").cast("double").alias("_p"))

    def fill(key: tuple, ext: pa.Table, px: pa.Table) -> pa.Table:
        seg_id, by, bx = (k.as_py() for k in key)
        h, w = min(size, ext["_h"][0].as_py() - by * size), min(size, ext["_w"][0].as_py() - bx * size)
        img = np.zeros((h, w))
        img[px["_y"].to_numpy() - by * size, px["_x"].to_numpy() - bx * size] = px["_p"].to_numpy()
        return _rows([(seg_id, by, bx, h, w, img.tobytes())], MAP_SCHEMA)

    return every.groupBy(*_KEY).cogroup(px.groupBy("_seg", "_by", "_bx")).applyInArrow(fill, MAP_SCHEMA)


def pixels(blocks: DataFrame, size: int = 256, kind: str = "f8") -> DataFrame:
    """(seg_id, y, x, p) of block rows; one block at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = np.frombuffer(r["data"], kind).astype(np.float64)
                y, x = np.divmod(np.arange(len(p)), r["w"])
                yield pa.RecordBatch.from_arrays([pa.array([r["seg_id"]] * len(p), pa.string()), pa.array(y + r["by"] * size, pa.int32()), pa.array(x + r["bx"] * size, pa.int32()), pa.array(p)], names=["seg_id", "y", "x", "p"])

    return blocks.mapInArrow(run, "seg_id string, y int, x int, p double")


def _pieces(blocks: DataFrame, size: int, radius: int, kind: str) -> DataFrame:
    """Each block for itself, and its strips for the blocks around it: (dy, dx) is where the strip lies from there."""
    if radius > size:
        raise ValueError("a stencil reaches into the next block, not beyond: take larger blocks")
    steps = (0,) if not radius else (-1, 0, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                img, out = np.frombuffer(r["data"], kind).reshape(r["h"], r["w"]), []
                for dy in steps:
                    for dx in steps:
                        # the block above sees the first rows of this one below it
                        rows = {-1: img[-radius:], 0: img, 1: img[:radius]}[dy]
                        part = {-1: rows[:, -radius:], 0: rows, 1: rows[:, :radius]}[dx]
                        if r["by"] >= dy and r["bx"] >= dx:
                            out.append((r["seg_id"], r["by"] - dy, r["bx"] - dx, dy, dx, *part.shape, part.tobytes()))
                yield from _rows(out, _PIECE).to_batches()

    return blocks.select(*_KEY, "h", "w", "data").mapInArrow(cut, _PIECE)


def on_blocks(blocks: DataFrame, size: int, radius: int, fn: Callable[[np.ndarray], np.ndarray], *, kind: str = "f8", schema: str = MAP_SCHEMA, rows: Callable | None = None) -> DataFrame:
    """`fn` of every block with `radius` values around it, as far as the image reaches; its result's middle is the new block.

    A map's blocks must all be there, full but for the last ones of a row or column. rows: what to make of (key, fn's
    result, place of the block in it) instead, in `schema`. A task holds one block and its margins."""

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        found = {(r["dy"], r["dx"]): np.frombuffer(r["data"], kind).reshape(r["h"], r["w"]) for r in pieces.select(["dy", "dx", "h", "w", "data"]).to_pylist()}
        own = found.get((0, 0))
        if own is None:  # strips beyond the image's last block
            return _rows([], schema)
        h, w = own.shape
        height = {d: next((found[d, x].shape[0] for x in (0, -1, 1) if (d, x) in found), 0) for d in (-1, 0, 1)}
        width = {d: next((found[y, d].shape[1] for y in (0, -1, 1) if (y, d) in found), 0) for d in (-1, 0, 1)}
        whole = np.zeros((sum(height.values()), sum(width.values())), own.dtype)
        top, left = {-1: 0, 0: height[-1], 1: height[-1] + h}, {-1: 0, 0: width[-1], 1: width[-1] + w}
        for (dy, dx), part in found.items():
            whole[top[dy] : top[dy] + part.shape[0], left[dx] : left[dx] + part.shape[1]] = part
        out = fn(whole)
        place = (slice(top[0], top[0] + h), slice(left[0], left[0] + w))
        if rows is not None:
            return _rows(rows(key, out, place), schema)
        return _rows([(*(k.as_py() for k in key), h, w, np.ascontiguousarray(out[place]).tobytes())], schema)

    return _pieces(blocks, size, radius, kind).groupBy(*_KEY).applyInArrow(run, schema)


# --- stencils of one array, whose ends are the image's


def median(img: np.ndarray, radius: int = 1) -> np.ndarray:
    wide = np.pad(img, radius, "symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(wide, (2 * radius + 1, 2 * radius + 1))
    return np.median(windows, axis=(2, 3))


def box(img: np.ndarray, side: int) -> np.ndarray:
    """Mean of the square around each value: running sums along one axis, then the other."""
    for axis in (0, 1):
        wide = np.pad(img, [(side // 2, side - 1 - side // 2) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        total = np.cumsum(wide, axis=axis)
        total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis=axis)
        n = img.shape[axis]
        img = (np.take(total, np.arange(side, side + n), axis) - np.take(total, np.arange(n), axis)) / side
    return img


def dilated(ink: np.ndarray, radius: int) -> np.ndarray:
    return _moved(ink, radius, False, np.logical_or)


def eroded(ink: np.ndarray, radius: int) -> np.ndarray:
    """Places outside the array are ignored."""
    return _moved(ink, radius, True, np.logical_and)


def _moved(ink: np.ndarray, radius: int, outside: bool, join: Callable) -> np.ndarray:
    wide = np.pad(ink, radius, constant_values=outside)
    h, w = ink.shape
    out = np.full(ink.shape, outside)
    for dy, dx in disk(radius):
        out = join(out, wide[radius + dy : radius + dy + h, radius + dx : radius + dx + w])
    return out


# --- operators


def median_filter(blocks: DataFrame, size: int, radius: int = 1) -> DataFrame:
    return on_blocks(blocks, size, radius, lambda img: median(img, radius))


def box_mean(blocks: DataFrame, size: int, side: int) -> DataFrame:
    return on_blocks(blocks, size, side // 2, lambda img: box(img, side))


def adaptive_threshold(blocks: DataFrame, size: int, window: int = 31, offset: float = 0.05) -> DataFrame:
    return on_blocks(blocks, size, window // 2, lambda img: (img > box(img, window) + offset).astype(np.float64))


def above(level: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda img: img > level


def morphology(blocks: DataFrame, size: int, level: float, *steps: tuple[str, int]) -> DataFrame:
    """Blocks of 1 and 0: values above a level, then a chain of ("dilate" or "erode", radius), in one exchange."""
    ways = {"dilate": dilated, "erode": eroded}

    def run(img: np.ndarray) -> np.ndarray:
        ink = img > level
        for way, radius in steps:
            ink = ways[way](ink, radius)
        return ink.astype(np.float64)

    return on_blocks(blocks, size, sum(r for _, r in steps), run)


def filtered(blocks: DataFrame, size: int, *, radius: int = 1, close: int = 2, open_: int = 1, level: float = 0.40, share: float = 0.70) -> DataFrame:
    """The filter chain but for the contrast step, in one exchange: median, soft blend, threshold, closing, opening, mask, clip."""

    def run(img: np.ndarray) -> np.ndarray:
        mixed = share * (median(img, radius) if radius else img) + (1 - share) * img
        keep = mixed > level
        for way, r in ((dilated, close), (eroded, close), (eroded, open_), (dilated, open_)):
            keep = way(keep, r)
        return np.clip(np.where(keep, mixed, 0.0), 0.0, 1.0)

    return on_blocks(blocks, size, radius + 2 * close + 2 * open_, run)


_SEEN = "seg_id string, by int, bx int, h int, w int, data binary, labels array<long>, counts array<long>"


def labelled(blocks: DataFrame, size: int, level: float, *, eight: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of the values above a level. Returns the blocks as labels (a number below 2 ** 63 for each component of a block,
    0 elsewhere), the sizes (seg_id, label, n) of the blocks' components, and (seg_id, label, component) of those that touch
    one of another block. What is shuffled is border strips and labels, never pixels."""
    steps = ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if eight else 2]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ink = np.frombuffer(r["data"], "f8").reshape(r["h"], r["w"]) > level
                number = np.arange(ink.size).reshape(ink.shape)
                a, b = [number[ink]], [number[ink]]
                for dy, dx in steps:
                    one = (slice(0, ink.shape[0] - dy), slice(max(0, -dx), ink.shape[1] - max(0, dx)))
                    two = (slice(dy, ink.shape[0]), slice(max(0, dx), ink.shape[1] - max(0, -dx)))
                    both = ink[one] & ink[two]
                    a.append(number[one][both]), b.append(number[two][both])
                nodes, root = forest(np.concatenate(a), np.concatenate(b))
                out = np.zeros(ink.size, np.int64)
                # places of blocks take 40 bits, places in a block 22 of the other 23
                out[nodes] = ((r["by"] << 20 | r["bx"]) << 22) + root + 1
                found, n = np.unique(out[nodes], return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]]) if c == "seg_id" else pa.array([r[c]], pa.int32()) for c in ("seg_id", "by", "bx", "h", "w")), pa.array([out.tobytes()]), pa.array([found.tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64()))], names=["seg_id", "by", "bx", "h", "w", "data", "labels", "counts"])

    if size > 2048:
        raise ValueError("a block of labels is 2048 wide at most")
    local = written(blocks.select(*_KEY, "h", "w", "data").mapInArrow(label, _SEEN), "labels")

    def touching(key: tuple, whole: np.ndarray, place: tuple[slice, slice]) -> list[tuple]:
        """Pairs of labels of the block and of what lies right and below."""
        (y0, y1), (x0, x1) = ((p.start, p.stop) for p in place)
        pairs = []
        for dy, dx in (*steps, *((-a, -b) for a, b in steps)):
            ys, xs = slice(max(y0 + dy, 0), min(y1 + dy, whole.shape[0])), slice(max(x0 + dx, 0), min(x1 + dx, whole.shape[1]))
            there = whole[ys, xs]
            here = whole[ys.start - dy : ys.stop - dy, xs.start - dx : xs.stop - dx]
            other = (here > 0) & (there > 0) & (here >> 22 != there >> 22)
            pairs.append(np.column_stack([here[other], there[other]]))
        return [(key[0].as_py(), a, b) for a, b in np.unique(np.concatenate(pairs), axis=0).tolist()]

    edges = written(on_blocks(local, size, 1, lambda img: img, kind="i8", schema="seg_id string, a long, b long", rows=touching), "edges")
    node = lambda c: F.xxhash64("seg_id", c)
    ids = edges.select("seg_id", F.col("a").alias("label"), node("a").alias("id")).distinct()  # each edge is there from both sides
    found = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    joined = ids.join(found, "id", "left").select("seg_id", "label", F.coalesce("component", "id").alias("component"))
    sizes = local.select("seg_id", F.explode(F.arrays_zip("labels", "counts")).alias("c")).select("seg_id", F.col("c.labels").alias("label"), F.col("c.counts").alias("n"))
    return local.select(*_KEY, "h", "w", "data"), sizes, joined


def remove_small(blocks: DataFrame, size: int, level: float, least: int, *, eight: bool = False) -> DataFrame:
    """Values above a level stay where their component has `least` pixels or more; all else becomes 0."""
    labels, sizes, joined = labelled(blocks, size, level, eight=eight)
    s = sizes.join(joined, ["seg_id", "label"], "left").withColumn("whole", F.coalesce("component", F.xxhash64("seg_id", "label")))
    s = written(s.select("seg_id", "label", "n", "whole"), "sizes")
    small = s.groupBy("seg_id", "whole").agg(F.sum("n").alias("total")).where(F.col("total") < least)
    of_block = F.shiftright("label", 22)
    gone = s.join(small.select("seg_id", "whole"), ["seg_id", "whole"], "left_semi")
    gone = gone.select("seg_id", F.shiftright(of_block, 20).cast("int").alias("by"), (of_block % (1 << 20)).cast("int").alias("bx"), "label")
    # a block's labels are no more than its pixels
    gone = gone.groupBy(*_KEY).agg(F.collect_list("label").alias("gone"))
    three = blocks.select(*_KEY, "h", "w", "data").join(labels.select(*_KEY, F.col("data").alias("labels")), _KEY).join(gone, _KEY, "left")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                of = np.frombuffer(r["labels"], "i8")
                keep = (of > 0) & ~np.isin(of, np.array(r["gone"] or [], np.int64))
                yield from _rows([(*(r[c] for c in (*_KEY, "h", "w")), np.where(keep, np.frombuffer(r["data"], "f8"), 0.0).tobytes())], MAP_SCHEMA).to_batches()

    return three.mapInArrow(drop, MAP_SCHEMA)


# --- distance to ink, by strips


def _scan(ink: np.ndarray) -> np.ndarray:
    """Distance to the nearest ink of the same row; infinite in rows without."""
    n = ink.shape[-1]
    at = np.arange(n)
    left = np.maximum.accumulate(np.where(ink, at, -np.inf), axis=-1)
    right = np.minimum.accumulate(np.where(ink, at, np.inf)[..., ::-1], axis=-1)[..., ::-1]
    return np.minimum(at - left, right - at)


def envelope(f: np.ndarray) -> np.ndarray:
    """min over k of f[k] + (i - k) ** 2 for each i, along the first axis, by the lower envelope of the parabolas: each column's
    parabolas are put on a stack from which later ones push what they undercut. Infinite f take no part."""
    n, shape = len(f), f.shape[1:]
    f = f.reshape(n, -1)
    m = f.shape[1]
    column = np.arange(m)
    top = np.full(m, -1)  # place of the last parabola of each column's stack
    vertex, start = np.zeros((n, m), np.int64), np.full((n + 1, m), np.inf)
    for k in range(n):
        live = np.isfinite(f[k])
        while True:
            have = live & (top >= 0)
            v = vertex[np.maximum(top, 0), column]
            fv = f[v, column]
            with np.errstate(invalid="ignore"):
                meet = np.where(have, ((f[k] + k * k) - (fv + v * v)) / np.where(have, 2.0 * (k - v), 1.0), -np.inf)
            push = have & (meet <= start[np.maximum(top, 0), column])
            if not push.any():
                break
            top[push] -= 1
        top[live] += 1
        at = column[live]
        vertex[top[live], at], start[top[live], at] = k, meet[live]
    start[np.minimum(top + 1, n), column] = np.inf
    out, place = np.full((n, m), np.inf), np.zeros(m, np.int64)
    for i in range(n):
        while True:
            on = (place < top) & (start[np.minimum(place + 1, n), column] < i)
            if not on.any():
                break
            place[on] += 1
        v = vertex[place, column]
        out[i] = np.where(top >= 0, f[v, column] + (i - v) ** 2, np.inf)
    return out.reshape(n, *shape)


def distances(ink: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest ink of an image, or of each of several (n, y, x): row scans, then envelopes along the
    columns, so that the work is linear in the pixels. 0 everywhere without ink."""
    g = _scan(ink)
    d = envelope(np.moveaxis(g * g, -2, 0))
    return np.where(ink.any(axis=(-2, -1), keepdims=True), np.sqrt(np.moveaxis(d, 0, -2)), 0.0)


def distance_transform(blocks: DataFrame, size: int, level: float = 0.5) -> DataFrame:
    """Distance of every pixel to the nearest value above a level; 0 everywhere without any. Rows of blocks are scanned in strips,
    then columns of blocks: a task holds one strip, `size` wide and as long as the map."""

    def strips(fn: Callable[[np.ndarray], np.ndarray], along: str):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            parts = sorted(t.to_pylist(), key=lambda r: r[along])
            axis = 1 if along == "bx" else 0
            whole = fn(np.concatenate([np.frombuffer(r["data"], "f8").reshape(r["h"], r["w"]) for r in parts], axis=axis))
            ends = np.cumsum([r["w" if axis else "h"] for r in parts])[:-1]
            return _rows([(*(r[c] for c in (*_KEY, "h", "w")), np.ascontiguousarray(x).tobytes()) for r, x in zip(parts, np.split(whole, ends, axis=axis), strict=True)], MAP_SCHEMA)

        return run

    def down(g: np.ndarray) -> np.ndarray:
        d = np.sqrt(envelope(g * g))
        return np.where(np.isfinite(d), d, 0.0)  # only a map without ink has columns without a finite distance

    rows = blocks.select(*_KEY, "h", "w", "data").groupBy("seg_id", "by").applyInArrow(strips(lambda p: _scan(p > level), "bx"), MAP_SCHEMA)
    return rows.groupBy("seg_id", "bx").applyInArrow(strips(down, "by"), MAP_SCHEMA)
