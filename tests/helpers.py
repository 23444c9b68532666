"""Small grids in and out of DataFrames, and brute-force oracles."""

import numpy as np

from rasterloom.model import META_SCHEMA


def meta_of(spark, shapes, px=1.0, py=1.0, x0=0.0, y0=0.0):
    rows = [(rid, 32736, h, w, 1, "float32", None, x0, y0, px, py) for rid, (h, w) in shapes.items()]
    return spark.createDataFrame(rows, META_SCHEMA)


def pixels_of(spark, grids, band=1):
    rows = [(rid, band, int(y), int(x), None if np.isnan(v) else float(v))
            for rid, g in grids.items() for (y, x), v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "raster_id string, band int, y bigint, x bigint, v double")


def grid_of(df, shape, rid="r", column="v", fill=np.nan):
    out = np.full(shape, fill)
    for row in df.filter(df.raster_id == rid).select("y", "x", column).collect():
        out[row[0], row[1]] = np.nan if row[2] is None else row[2]
    return out


def mirror(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def blur_brute(g, sigma):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for _ in range(2):
        n = g.shape[0]
        g = np.array([sum(w[d + r] * g[mirror(i + d, n)] for d in range(-r, r + 1)) for i in range(n)]).T
    return g


def min_brute(g, size):
    lo, hi = size // 2, size - size // 2 - 1
    h, w = g.shape
    out = np.full(g.shape, np.nan)
    for y in range(h):
        for x in range(w):
            part = g[max(0, y - lo):y + hi + 1, max(0, x - lo):x + hi + 1]
            if not np.isnan(part).all():
                out[y, x] = np.nanmin(part)
    return out


def slope_brute(g):
    p = np.pad(np.nan_to_num(g), 1, mode="symmetric")
    h, w = g.shape
    at = lambda dy, dx: p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w]
    gx = sum(k * (at(dy, 1) - at(dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(1, dx) - at(-1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1)))
    return np.hypot(gx, gy)


def inside(rings, x, y):
    """Even-odd test of a point with the half-open edge rule."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if min(ay, by) <= y < max(ay, by) and ax + (y - ay) / (by - ay) * (bx - ax) <= x:
                odd = not odd
    return odd
