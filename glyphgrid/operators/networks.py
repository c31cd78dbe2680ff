"""Forward passes of convolutional networks in NumPy, with weights that are given.

Weights are arrays by name, as a training framework saves them; a loader in the form that `tiles.predict_tiles` takes
makes the function once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Channels of the volume stages and of the image stages, and what normalisation adds to a variance.
STAGES, HEADS, EPS = ((1, 16), (16, 32), (32, 64)), ((64, 32), (32, 16)), 1e-5


def convolved(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Convolution of (batch, channels, *space) with (out, in, *kernel), zeros around, same size: one matrix product for each
    place of the kernel."""
    space, kernel = x.shape[2:], w.shape[2:]
    wide = np.pad(x, [(0, 0), (0, 0), *((k // 2, k // 2) for k in kernel)])
    out = np.zeros((x.shape[0], *space, w.shape[0]), x.dtype)
    for at in np.ndindex(*kernel):
        part = wide[(slice(None), slice(None), *(slice(a, a + n) for a, n in zip(at, space, strict=True)))]
        out += np.moveaxis(part, 1, -1) @ w[(slice(None), slice(None), *at)].T
    return np.moveaxis(out, -1, 1)


def normalised(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    """Batch normalisation by stored statistics."""
    shape = (1, -1, *(1,) * (x.ndim - 2))
    scale = w[f"{name}.weight"] / np.sqrt(w[f"{name}.running_var"] + EPS)
    return x * scale.reshape(shape) + (w[f"{name}.bias"] - w[f"{name}.running_mean"] * scale).reshape(shape)


def segment_logits(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """(batch, z, y, x) to log odds (batch, y, x): three volume stages of two convolutions, the layers halved by maxima
    after the first two and averaged after the third, then two image stages and a weighted sum of the channels."""
    x = x[:, None].astype(np.float32)
    for k in range(len(STAGES)):
        for i in (0, 1):
            x = np.maximum(normalised(convolved(x, w[f"enc{k + 1}.{3 * i}.weight"]), w, f"enc{k + 1}.{3 * i + 1}"), 0)
        if k < len(STAGES) - 1 and x.shape[2] > 1:
            n = x.shape[2] // 2
            x = x[:, :, : 2 * n].reshape(*x.shape[:2], n, 2, *x.shape[3:]).max(axis=3)
    x = x.mean(axis=2)
    for k in range(len(HEADS)):
        x = np.maximum(normalised(convolved(x, w[f"dec{k + 1}.0.weight"]), w, f"dec{k + 1}.1"), 0)
    return np.einsum("bcyx,c->byx", x, w["head.weight"].reshape(-1)) + w["head.bias"].reshape(())


def drawn_weights(seed: int) -> dict[str, np.ndarray]:
    """Weights of the right shapes, drawn by a seed."""
    rng = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}

    def layer(conv: str, norm: str, ci: int, co: int, kernel: tuple[int, ...]) -> None:
        out[f"{conv}.weight"] = rng.normal(scale=(2 / (ci * np.prod(kernel))) ** 0.5, size=(co, ci, *kernel)).astype(np.float32)
        out[f"{norm}.weight"], out[f"{norm}.bias"] = rng.uniform(0.5, 1.5, co).astype(np.float32), rng.normal(scale=0.1, size=co).astype(np.float32)
        out[f"{norm}.running_mean"], out[f"{norm}.running_var"] = rng.normal(scale=0.1, size=co).astype(np.float32), rng.uniform(0.5, 1.5, co).astype(np.float32)

    for k, (ci, co) in enumerate(STAGES):
        layer(f"enc{k + 1}.0", f"enc{k + 1}.1", ci, co, (3, 3, 3))
        layer(f"enc{k + 1}.3", f"enc{k + 1}.4", co, co, (3, 3, 3))
    for k, (ci, co) in enumerate(HEADS):
        layer(f"dec{k + 1}.0", f"dec{k + 1}.1", ci, co, (3, 3))
    out["head.weight"], out["head.bias"] = rng.normal(scale=0.3, size=(1, HEADS[-1][1], 1, 1)).astype(np.float32), np.zeros(1, np.float32)
    return out


def segment_network(weights: dict[str, np.ndarray]) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader of the network as a function from tiles to probabilities."""
    return lambda: lambda x: 1 / (1 + np.exp(-segment_logits(x, weights).astype(np.float64)))
