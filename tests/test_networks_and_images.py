"""Forward passes against plain loops, and image files against their definitions."""

import struct
import zlib

import numpy as np
import pytest

from glyphgrid.operators import networks
from glyphgrid.sources import raster


def brute_conv(x, w):
    out = np.zeros((w.shape[0], *x.shape[1:]))
    for o in range(w.shape[0]):
        for at in np.ndindex(*x.shape[1:]):
            for k in np.ndindex(*w.shape[2:]):
                p = tuple(a + b - n // 2 for a, b, n in zip(at, k, w.shape[2:], strict=True))
                if all(0 <= a < n for a, n in zip(p, x.shape[1:], strict=True)):
                    out[(o, *at)] += sum(x[(c, *p)] * w[(o, c, *k)] for c in range(x.shape[0]))
    return out


def test_convolution_equals_loops():
    rng = np.random.default_rng(0)
    for space, kernel in (((3, 4, 5), (3, 3, 3)), ((5, 4), (3, 3)), ((4, 3), (1, 1))):
        x, w = rng.normal(size=(2, 2, *space)), rng.normal(size=(3, 2, *kernel))
        got = networks.convolved(x, w)
        assert all(np.allclose(got[b], brute_conv(x[b], w)) for b in range(2))


def test_segment_network_equals_loops(monkeypatch):
    monkeypatch.setattr(networks, "STAGES", ((1, 2), (2, 3), (3, 2)))
    monkeypatch.setattr(networks, "HEADS", ((2, 2), (2, 1)))
    w = networks.drawn_weights(1)
    x = np.random.default_rng(2).normal(size=(2, 5, 3, 4)).astype(np.float32)

    def norm(v, name):
        shape = (-1, *(1,) * (v.ndim - 1))
        g, b, m, s = (w[f"{name}.{k}"].reshape(shape) for k in ("weight", "bias", "running_mean", "running_var"))
        return np.maximum((v - m) / np.sqrt(s + 1e-5) * g + b, 0)

    for b in range(2):
        v = x[b][None].astype(float)
        for k in (1, 2, 3):
            v = norm(brute_conv(v, w[f"enc{k}.0.weight"]), f"enc{k}.1")
            v = norm(brute_conv(v, w[f"enc{k}.3.weight"]), f"enc{k}.4")
            if k < 3 and v.shape[1] > 1:
                v = np.stack([v[:, 2 * z : 2 * z + 2].max(axis=1) for z in range(v.shape[1] // 2)], axis=1)
        v = v.mean(axis=1)
        for k in (1, 2):
            v = norm(brute_conv(v, w[f"dec{k}.0.weight"]), f"dec{k}.1")
        v = brute_conv(v, w["head.weight"])[0] + w["head.bias"][0]
        assert np.allclose(networks.segment_logits(x, w)[b], v, atol=1e-4)
    p = networks.segment_network(w)()(x)
    assert p.shape == (2, 3, 4) and (0 < p).all() and (p < 1).all()


def png(img, way):
    """Rows coded by one filter, byte by byte."""
    step = img.dtype.itemsize
    raw = img.astype(f">u{step}").tobytes() if step > 1 else img.tobytes()
    width = img.shape[1] * step
    rows = [raw[y * width : (y + 1) * width] for y in range(img.shape[0])]
    out = b""
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else bytes(width)
        line = []
        for k, v in enumerate(row):
            a, b, c = (row[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[way]) % 256)
        out += bytes([way]) + bytes(line)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8 * step, 0, 0, 0, 0)
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"tEXt", b"a\0b") + part(b"IDAT", packed[:20]) + part(b"IDAT", packed[20:]) + part(b"IEND", b"")


@pytest.mark.parametrize("way", range(5))
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_filters(way, kind):
    img = np.random.default_rng(way).integers(0, np.iinfo(kind).max, (7, 9)).astype(kind)
    assert (raster.decode(png(img, way)) == img).all()
    if kind is np.uint8:
        assert (raster.decode(raster.encode_png(img)) == img).all()


def lzw(data):
    """Codes that begin with a clear and end with the end mark; widths grow one code early."""
    table, width, bits, n = {bytes([k]): k for k in range(256)}, 9, 256, 9
    have, last = b"", 258
    for b in data:
        if have + bytes([b]) in table:
            have += bytes([b])
            continue
        bits, n = (bits << width) | table[have], n + width
        table[have + bytes([b])] = last
        last += 1
        if last == (1 << width) and width < 12:
            width += 1
        if last >= 4094:
            bits, n = (bits << width) | 256, n + width
            table, width, last = {bytes([k]): k for k in range(256)}, 9, 258
        have = bytes([b])
    if have:
        bits, n = (bits << width) | table[have], n + width
        last += 1
        if last == (1 << width) and width < 12:
            width += 1
    bits, n = (bits << width) | 257, n + width
    return (bits << (-n % 8)).to_bytes((n + 7) // 8, "big")


def tiff(img, packing, pack, differences=False):
    raw = img if not differences else np.concatenate([img[:, :1], np.diff(img, axis=1).astype(img.dtype)], axis=1)
    body = pack(raw.tobytes())
    tags = [(256, img.shape[1]), (257, img.shape[0]), (258, 8 * img.dtype.itemsize), (259, packing), (273, 8), (277, 1), (279, len(body)), (317, 2 if differences else 1)]
    return b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)


@pytest.mark.parametrize("differences", [False, True])
def test_packed_tiffs(differences):
    rng = np.random.default_rng(3)
    for kind in (np.uint8, np.uint16):
        for img in (rng.integers(0, 200, (40, 60)).astype(kind), (rng.random((100, 200)) < 0.1).astype(kind), np.zeros((3, 5), kind)):
            runs = lambda b: b"".join(bytes([len(b[i : i + 128]) - 1]) + b[i : i + 128] for i in range(0, len(b), 128))
            for packing, pack in ((1, bytes), (5, lzw), (8, zlib.compress), (32773, runs)):
                assert (raster.decode(tiff(img, packing, pack, differences)) == img).all()
    assert raster._run_lengths(bytes([254, 7, 128, 1, 5, 6])) == bytes([7, 7, 7, 5, 6])
