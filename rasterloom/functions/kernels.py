"""Small numpy kernels applied to one haloed block inside a task."""

from __future__ import annotations

import numpy as np


def gaussian_radius(sigma: float) -> int:
    """Fixed value: the kernel is cut at four standard deviations."""
    return int(4.0 * sigma + 0.5)


def gaussian_weights(sigma: float, radius: int | None = None) -> list[float]:
    r = gaussian_radius(sigma) if radius is None else radius
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def convolve_rows(block: np.ndarray, weights) -> np.ndarray:
    """Weighted sum along axis 0; the result is shorter by ``len(weights) - 1`` rows."""
    n = block.shape[0] - len(weights) + 1
    out = np.zeros((n, block.shape[1]))
    for k, w in enumerate(weights):
        out += w * block[k:k + n]
    return out


def blur_block(block: np.ndarray, weights) -> np.ndarray:
    return convolve_rows(convolve_rows(block, weights).T, weights).T


def sliding_min_rows(block: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive rows, ignoring NaN; NaN where all of them are.

    Rows are cut into groups of ``size``; a window covers the tail of one group and the head of
    the next, so running minima from both directions answer it in two look-ups.
    """
    if np.isinf(block).any():  # an infinite minimum may then be a value
        present = sliding_min_rows(np.where(np.isnan(block), 1.0, 0.0), size) == 0
        big = np.finfo(float).max
        out = sliding_min_rows(np.where(np.isinf(block), np.sign(block) * big, block), size)
        return np.where(present, np.where(np.abs(out) == big, np.sign(out) * np.inf, out), np.nan)
    n = block.shape[0] - size + 1
    groups = -(-block.shape[0] // size)
    filled = np.full((groups * size, block.shape[1]), np.inf)
    filled[:block.shape[0]] = np.where(np.isnan(block), np.inf, block)
    cube = filled.reshape(groups, size, -1)
    head = np.minimum.accumulate(cube, axis=1).reshape(filled.shape)
    tail = np.minimum.accumulate(cube[:, ::-1], axis=1)[:, ::-1].reshape(filled.shape)
    out = np.minimum(tail[:n], head[size - 1:size - 1 + n])
    return np.where(np.isinf(out), np.nan, out)


def slope_block(block: np.ndarray) -> np.ndarray:
    """Sobel magnitude of a block with a halo of one; missing counts as 0."""
    b = np.nan_to_num(block, nan=0.0)
    smooth, diff = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)
    gx = convolve_rows(convolve_rows(b, smooth).T, diff).T
    gy = convolve_rows(convolve_rows(b, diff).T, smooth).T
    return np.sqrt(gx * gx + gy * gy)


def distort(channel: np.ndarray, my: np.ndarray, mx: np.ndarray, nearest: bool) -> np.ndarray:
    """Sample a patch at fractional positions, bilinear or nearest, edges clamped."""
    h, w = channel.shape
    my, mx = np.clip(my, 0, h - 1)[:, None], np.clip(mx, 0, w - 1)[None, :]
    if nearest:
        return channel[np.floor(my + 0.5).astype(int), np.floor(mx + 0.5).astype(int)]
    y0, x0 = np.floor(my).astype(int), np.floor(mx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = my - y0, mx - x0
    top = channel[y0, x0] * (1 - fx) + channel[y0, x1] * fx
    low = channel[y1, x0] * (1 - fx) + channel[y1, x1] * fx
    return top * (1 - fy) + low * fy


def grid_map(size: int, stretches: list[float]) -> np.ndarray:
    """Piecewise-linear source positions: each step of the grid is stretched by its factor and the
    whole is rescaled to the patch."""
    edges = np.concatenate([[0.0], np.cumsum(stretches)])
    edges = edges / edges[-1] * (size - 1)
    return np.interp(np.arange(size), np.linspace(0, size - 1, len(edges)), edges)
