"""Neighbourhood operators on the pixel form, in Column expressions only.

These are the readable definitions and the choice for small or sparse rasters. For wide kernels
use :mod:`rasterloom.operators.tiles`, which gives the same numbers with far less shuffle.
Inputs carry the raster's ``height`` and ``width``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions import kernels
from rasterloom.runtime import lookup_join

KEY = ["raster_id"]


#: Cells of a line that are computed together, at least; eight radii if these are more.
LINE = 256


def with_dims(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    return lookup_join(pixels, meta.select("raster_id", "height", "width"), "raster_id", "inner")


def _deal(df: DataFrame, axis: str, first: Column, last: Column, side: int, keys: list[str], parts: int | None) -> DataFrame:
    """Send every row to the blocks ``_b`` of its line that hold a position of [first, last], as the only
    exchange: what is grouped or ordered by block and line afterwards stays in its partition. ``parts`` keeps
    a partition's size from growing with the raster (see :func:`rasterloom.model.cell_parts`)."""
    other = "x" if axis == "y" else "y"
    sent = df.withColumn("_b", F.explode(F.sequence(F.floor(first / side), F.floor(last / side))))
    return sent.repartition(*([parts] if parts else []), *keys, other, "_b")


def spread(df: DataFrame, axis: str, length: str, weights: dict[str, list[float]], keys: list[str], parts: int | None = None) -> DataFrame:
    """Send every cell along one axis to the cells whose window covers it and sum there.

    Mirrored borders are handled at the sender: a cell also sends as each of its mirror images
    that lies within reach. A cell is shuffled once per block of its line that it reaches, and meets its
    targets there. ``weights`` maps every output column to its taps; a column of that name is weighed if
    there is one, else ``v``.
    """
    taps = len(next(iter(weights.values())))
    r = taps // 2
    side = max(LINE, 8 * r)
    other = "x" if axis == "y" else "y"
    n, at = F.col(length), F.col(axis)
    # images repeat every 2n cells; only as many as the radius can reach
    reps = F.sequence(-F.ceil(F.lit(r) / (2 * n)), F.ceil(F.lit(r) / (2 * n)))
    images = F.flatten(F.transform(reps, lambda k: F.array(at + 2 * n * k, 2 * n * k - 1 - at)))
    near = F.filter(images, lambda q: (q >= -r) & (q < n + r))
    df = df.withColumn("_q", F.explode(F.when((at >= r) & (at < n - r), F.array(at)).otherwise(near)))
    first, last = F.greatest(F.lit(0), F.col("_q") - r), F.least(n - 1, F.col("_q") + r)
    dealt = _deal(df, axis, first, last, side, keys, parts)
    to = F.sequence(F.greatest(first, F.col("_b") * side), F.least(last, F.col("_b") * side + (side - 1)))
    sent = dealt.withColumn("_t", F.explode(to))
    tap = (F.col("_q") - F.col("_t") + r + 1).cast("int")
    pick = lambda ws: F.element_at(F.array(*[F.lit(float(w)) for w in ws]), tap)
    return (
        sent.groupBy(*keys, "height", "width", "_b", F.col("_t").cast("bigint").alias(axis), other)
        .agg(*[F.sum(pick(ws) * F.col(name if name in df.columns else "v")).alias(name)
               for name, ws in weights.items()]).drop("_b")
    )


def gaussian_blur(pixels: DataFrame, sigma: float, keys: list[str] = KEY, parts: int | None = None) -> DataFrame:
    """Separable blur. Absent and missing cells count as 0 and send nothing; cells no value reaches
    are absent from the result (their blurred value is 0)."""
    w = kernels.gaussian_weights(sigma)
    lit = pixels.filter("v <> 0").select(*keys, "height", "width", "y", "x", "v")
    down = spread(lit, "y", "height", {"v": w}, keys, parts)
    return spread(down, "x", "width", {"v": w}, keys, parts)


def gradient_magnitude(pixels: DataFrame, keys: list[str] = KEY, parts: int | None = None) -> DataFrame:
    """Sobel magnitude; cells with no neighbour value are absent (their slope is 0)."""
    smooth, diff = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]
    src = pixels.filter("v <> 0").select(*keys, "height", "width", "y", "x", "v")
    down = spread(src, "y", "height", {"gx": smooth, "gy": diff}, keys, parts)
    both = spread(down, "x", "width", {"gx": diff, "gy": smooth}, keys, parts)
    return both.withColumn("v", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).drop("gx", "gy")


def _min_along(df: DataFrame, axis: str, length: str, windows: dict[str, tuple[str, int]], keys: list[str], parts: int | None) -> DataFrame:
    """Sliding minima along one axis; ``windows`` maps every output column to its source and window.

    Lines are cut into blocks with the halo of the widest window; frames and groups are bounded by a
    block, whatever the raster size. All windows share one exchange and one sort.
    """
    before, after = max(w // 2 for _, w in windows.values()), max(w - w // 2 - 1 for _, w in windows.values())
    side = max(LINE, 8 * (before + after))
    other = "x" if axis == "y" else "y"
    at = F.col(axis)
    dealt = _deal(df, axis, F.greatest(F.lit(0), at - after), F.least(F.col(length) - 1, at + before), side, keys, parts)
    line = W.partitionBy(*keys, other, "_b").orderBy(axis)
    frame = lambda w: line.rangeBetween(-(w // 2), w - w // 2 - 1)
    lows = [F.min(source).over(frame(w)).alias(name) for name, (source, w) in windows.items()]
    return dealt.select(*keys, "height", "width", "y", "x", "_b", *lows).filter(F.floor(at / side) == F.col("_b")).drop("_b")


def min_filter(pixels: DataFrame, window: int, keys: list[str] = KEY, parts: int | None = None) -> DataFrame:
    """Minimum over ``[i - window//2, i + window - window//2 - 1]`` in both directions, clipped to
    the raster (equal to mirrored edges). Needs every grid cell; missing cells hold NULL."""
    return local_min_surface(pixels, [window], keys, parts)


def local_min_surface(pixels: DataFrame, windows: list[int], keys: list[str] = KEY, parts: int | None = None) -> DataFrame:
    """Cell-wise mean of several minimum filters; NULL where nothing is in reach. Two exchanges."""
    grid = pixels.select(*keys, "height", "width", "y", "x", "v")
    names = [f"_m{i}" for i in range(len(windows))]
    down = _min_along(grid, "y", "height", {m: ("v", w) for m, w in zip(names, windows)}, keys, parts)
    both = _min_along(down, "x", "width", {m: (m, w) for m, w in zip(names, windows)}, keys, parts)
    total = F.col(names[0])
    for m in names[1:]:
        total = total + F.col(m)
    return both.select(*keys, "height", "width", "y", "x", (total / len(windows)).alias("v"))
