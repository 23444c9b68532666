"""Neighbourhood operators on the tile form: halo exchange followed by a block kernel.

Every tile sends each neighbour only the strip that neighbour needs, so the shuffle is
``(1 + 2r/T)`` times the data per filtered axis. Small tiles are computed together, as one block of up to
``BLOCK_SIDE`` cells a side; a group is never larger than one haloed block or tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import kernels
from rasterloom.model import TILE_SCHEMA, list_rows, strip_batches, tile_batches, tile_table, tiles_per_block

Kernel = Callable[[np.ndarray], np.ndarray]

_STRIP_SCHEMA = (
    "raster_id string, band int, ty int, tx int, rh int, rw int, sy int, sx int, sh int, sw int, "
    "own boolean, data array<double>"
)
_STRIP_ARROW = pa.schema(
    [("raster_id", pa.string()), ("band", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()),
     ("rh", pa.int32()), ("rw", pa.int32()), ("sy", pa.int32()), ("sx", pa.int32()),
     ("sh", pa.int32()), ("sw", pa.int32()), ("own", pa.bool_()), ("data", pa.list_(pa.float64()))]
)


def _targets(start: int, stop: int, before: int, after: int, size: int, length: int):
    """Tile numbers along one axis that need any cell of ``[start, stop)``, with the part needed."""
    last = (length - 1) // size
    for t in range(max(0, (start - after) // size), min(last, (stop - 1 + before) // size) + 1):
        lo = max(start, t * size - before)
        hi = min(stop, min((t + 1) * size, length) + after)
        if lo < hi:
            yield t, lo, hi


def halo_exchange(tiles: DataFrame, size: int, ry: tuple[int, int], rx: tuple[int, int], block: int = 1) -> DataFrame:
    """Strips addressed to the tile that needs them; ``own`` marks the tile's own block.

    ``ry`` and ``rx`` are the cells needed before and after the tile; radii above the tile size
    reach over several rings of neighbours. With ``block``, strips go to (and ``ty``, ``tx`` number)
    squares of that many tiles a side, and every tile of a square is ``own``.
    """
    side = size * block

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "data"}
            for i, flat in enumerate(list_rows(batch.column("data"))):
                ty, tx, h, w = (cols[c][i] for c in ("ty", "tx", "h", "w"))
                rh, rw = cols["rh"][i], cols["rw"][i]
                y0, x0 = ty * size, tx * size
                grid = flat.reshape(h, w)
                for ny, a, b in _targets(y0, y0 + h, *ry, side, rh):
                    for nx, c, d in _targets(x0, x0 + w, *rx, side, rw):
                        own = ny == ty // block and nx == tx // block
                        yield ((cols["raster_id"][i], cols["band"][i], ny, nx, rh, rw, a, c, b - a, d - c, own),
                               grid[a - y0:b - y0, c - x0:d - x0].ravel())

    return tile_batches(tiles).mapInArrow(lambda batches: strip_batches(strips(batches), _STRIP_ARROW), _STRIP_SCHEMA)


def _pad(block: np.ndarray, widths, edge: str | float) -> np.ndarray:
    if edge == "mirror":
        return np.pad(block, widths, mode="symmetric")
    return np.pad(block, widths, constant_values=float(edge))


def map_tiles(tiles: DataFrame, kernel: Kernel, size: int, ry: tuple[int, int] = (0, 0),
              rx: tuple[int, int] = (0, 0), edge: str | float = "mirror") -> DataFrame:
    """Apply ``kernel`` to every tile (or block of small tiles) with its halo; the kernel returns the own cells.

    ``edge`` says how the halo outside the raster is made: ``"mirror"`` repeats the border
    outwards, a number is used as a constant. Tiles absent from the table count as missing (NaN)
    and get no output.
    """

    n = tiles_per_block(size)
    side = n * size

    def assemble(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rid, band, ty, tx, rh, rw = (k.as_py() for k in key)
        places = [table.column(c).to_pylist() for c in ("sy", "sx", "sh", "sw")]
        mine = [p for p, own in zip(zip(*places), table.column("own").to_pylist()) if own]
        if not mine:
            return tile_table({c: [] for c in ("raster_id", "band", "ty", "tx", "h", "w", "rh", "rw")}, [])
        y0, x0 = ty * side, tx * side
        y1, x1 = min(y0 + side, rh), min(x0 + side, rw)
        ay, ax = max(0, y0 - ry[0]), max(0, x0 - rx[0])
        by, bx = min(rh, y1 + ry[1]), min(rw, x1 + rx[1])
        block = np.full((by - ay, bx - ax), np.nan)
        for sy, sx, sh, sw, flat in zip(*places, list_rows(table.column("data"))):
            block[sy - ay:sy - ay + sh, sx - ax:sx - ax + sw] = flat.reshape(sh, sw)
        widths = ((ry[0] - (y0 - ay), ry[1] - (by - y1)), (rx[0] - (x0 - ax), rx[1] - (bx - x1)))
        out = kernel(_pad(block, widths, edge))
        m, (sy, sx, sh, sw) = len(mine), zip(*mine)
        ids = dict(raster_id=[rid] * m, band=[band] * m, ty=[y // size for y in sy], tx=[x // size for x in sx], h=sh, w=sw, rh=[rh] * m, rw=[rw] * m)
        return tile_table(ids, [out[y - y0:y - y0 + h, x - x0:x - x0 + w].ravel() for y, x, h, w in mine])

    strips = halo_exchange(tiles, size, ry, rx, n)
    return strips.groupBy("raster_id", "band", "ty", "tx", "rh", "rw").applyInArrow(assemble, TILE_SCHEMA)


def gaussian_blur(tiles: DataFrame, sigma: float, size: int) -> DataFrame:
    weights = kernels.gaussian_weights(sigma)
    r = kernels.gaussian_radius(sigma)
    return map_tiles(tiles, lambda b: kernels.blur_block(b, weights), size, (r, r), (r, r))


def gradient_magnitude(tiles: DataFrame, size: int) -> DataFrame:
    return map_tiles(tiles, kernels.slope_block, size, (1, 1), (1, 1))


def smooth_gradient(tiles: DataFrame, sigma: float, size: int) -> DataFrame:
    """Gradient magnitude and blur in one exchange with a halo of the blur radius plus one.

    The magnitude of mirrored data is the mirrored magnitude, so the result equals the two steps.
    """
    weights = kernels.gaussian_weights(sigma)
    r = kernels.gaussian_radius(sigma) + 1
    return map_tiles(tiles, lambda b: kernels.blur_block(kernels.slope_block(b), weights), size, (r, r), (r, r))


def min_filter(tiles: DataFrame, window: int, size: int) -> DataFrame:
    """Minimum over ``[i - window//2, i + window - window//2 - 1]`` in both directions.

    Outside the raster nothing is added to the window, which equals mirrored edges for a minimum.
    """
    return local_min_surface(tiles, [window], size)


def _min_by_axis(tiles: DataFrame, window: int, size: int) -> DataFrame:
    """Two one-directional passes: two thin halos instead of a square one."""
    halo = (window // 2, window - window // 2 - 1)
    down = map_tiles(tiles, lambda b: kernels.sliding_min_rows(b, window), size, ry=halo, edge=float("nan"))
    return map_tiles(down, lambda b: kernels.sliding_min_rows(b.T, window).T, size, rx=halo, edge=float("nan"))


def local_min_surface(tiles: DataFrame, windows: list[int], size: int, passes: bool = False) -> DataFrame:
    """Cell-wise mean of several minimum filters.

    A square halo of the widest window serves all windows in one exchange and sends
    ``(1 + w/T)**2`` times the data; with ``passes``, two one-directional exchanges per window send
    about ``2k(1 + w/T)`` times, which is less for windows of many tiles. The values are the same.
    """
    if passes:
        return _mean_of_passes(tiles, windows, size)
    widest = max(windows)
    halo = (widest // 2, widest - widest // 2 - 1)

    def lowest(block: np.ndarray) -> np.ndarray:
        total = 0.0
        for w in windows:
            before, after = halo[0] - w // 2, halo[1] - (w - w // 2 - 1)
            part = block[before:block.shape[0] - after, before:block.shape[1] - after]
            total = total + kernels.sliding_min_rows(kernels.sliding_min_rows(part, w).T, w).T
        return total / len(windows)

    return map_tiles(tiles, lowest, size, halo, halo, edge=float("nan"))


def _mean_of_passes(tiles: DataFrame, windows: list[int], size: int) -> DataFrame:
    """One pair of passes per window, averaged per tile."""
    key = ["raster_id", "band", "ty", "tx"]
    total = _min_by_axis(tiles, windows[0], size)
    for w in windows[1:]:
        other = _min_by_axis(tiles, w, size).select(*key, F.col("data").alias("_other"))
        total = total.join(other, key).withColumn(
            "data", F.zip_with("data", "_other", lambda a, b: a + b)).drop("_other")
    return total.withColumn("data", F.transform("data", lambda s: s / len(windows)))
