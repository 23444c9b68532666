"""Ground detection: height above a local minimum, above a terrain model, or by slope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import pointwise as pw
from rasterloom.model import cell_parts, pixels_to_tiles, tiles_to_pixels, zip_tiles
from rasterloom.operators import focal, stats, tiles
from rasterloom.operators.overlay import CELL, overlay
from rasterloom.runtime import freeze, lookup_join

METHODS = ("local_min", "dtm", "gradient", "both")


def from_terrain(dsm: DataFrame, dtm: DataFrame, threshold: float) -> DataFrame:
    """Heights above an external terrain model; missing where either model is missing."""
    grid = overlay(dsm.select(*CELL, F.col("v").alias("dsm")), dtm=dtm)
    return _by_height(grid.withColumn("ndsm", F.col("dsm") - F.col("dtm")), threshold)


def _by_height(grid: DataFrame, threshold: float) -> DataFrame:
    h = F.col("ndsm")
    return grid.select(
        *CELL, "dsm", "ndsm", pw.below(h, threshold).alias("ground"), pw.height_confidence(h, threshold).alias("conf"))


def as_tiles(dsm: DataFrame, meta: DataFrame, tile: int) -> DataFrame:
    """Pack a pixel surface on the complete tile grid; a table already in tile form passes."""
    return dsm if "data" in dsm.columns else pixels_to_tiles(dsm.withColumn("band", F.lit(1)), meta, tile, float("nan"))


def from_local_min(dsm: DataFrame, meta: DataFrame, windows: list[int], threshold: float,
                   tile: int | None = 256) -> DataFrame:
    """Heights above the mean of several minimum filters.

    A window always covers its own cell, so the minimum at a present cell never depends on what
    missing cells are filled with; a minimum that skips them gives the same heights as filling
    with the global maximum first, without that extra pass. ``dsm`` is a tile table, or pixels
    (on the complete grid when ``tile`` is None, which selects the pixel form).
    """
    if tile is None:
        low = focal.local_min_surface(focal.with_dims(dsm, meta), windows, parts=cell_parts(meta))
        grid = overlay(dsm.select(*CELL, F.col("v").alias("dsm")), low=low)
    else:
        packed = as_tiles(dsm, meta, tile)
        grid = zip_tiles(tile, dsm=packed, low=tiles.local_min_surface(packed, windows, tile))
    return _by_height(grid.withColumn("ndsm", F.col("dsm") - F.col("low")), threshold)


def slope_surface(dsm: DataFrame, meta: DataFrame, sigma: float, tile: int | None = 256) -> DataFrame:
    """Smoothed gradient magnitude of every cell, next to the surface value itself."""
    if tile is None:
        parts = cell_parts(meta)
        steep = focal.gaussian_blur(focal.gradient_magnitude(focal.with_dims(dsm, meta), parts=parts), sigma, parts=parts)
        joined = overlay(dsm.select(*CELL, F.col("v").alias("dsm")), slope=steep)
        return joined.withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    packed = as_tiles(dsm, meta, tile)
    return zip_tiles(tile, dsm=packed, slope=tiles.smooth_gradient(packed, sigma, tile))


def from_slope(dsm: DataFrame, meta: DataFrame, sigma: float, threshold: float | None = None,
               tile: int | None = 256, surface: DataFrame | None = None) -> DataFrame:
    """Flat cells are ground. Without a threshold the automatic one of the raster is used."""
    grid = freeze(slope_surface(dsm, meta, sigma, tile)) if surface is None else surface  # read several times below
    as_raster = grid.select(*CELL, F.col("slope").alias("v"))
    # slopes are never negative: without a positive one the largest is 0
    scalars = stats.upper_height(as_raster).select(
        "raster_id", F.greatest(F.coalesce("p95", F.lit(0.0)), F.lit(1e-8)).alias("_scale"))
    if threshold is None:
        scalars = scalars.join(stats.otsu_threshold(as_raster), "raster_id")
    else:
        scalars = scalars.withColumn("threshold", F.lit(float(threshold)))
    g, here = F.col("slope"), F.col("dsm").isNotNull()
    conf = 1.0 - pw.clamp(g / F.col("_scale"), 0.0, 1.0)
    return lookup_join(grid, scalars, "raster_id").select(
        *CELL, "dsm", "slope", "threshold",
        (here & (g < F.col("threshold"))).alias("ground"),
        F.when(here, conf).otherwise(0.0).alias("conf"))


def combine(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """Merge two detections of the same grid."""
    right = b.select(*CELL, F.col("ground").alias("_g"), F.col("conf").alias("_c"))
    joined = a.join(right, CELL)
    return (
        joined.withColumn("ground", pw.merge_binary(F.col("ground"), F.col("_g"), mode))
        .withColumn("conf", pw.merge_confidence(F.col("conf"), F.col("_c"), mode))
        .drop("_g", "_c")
    )


def detect(dsm: DataFrame, meta: DataFrame, method: str, *, dtm: DataFrame | None = None,
           windows: list[int] | None = None, height_threshold: float = 2.0, sigma: float = 2.0,
           slope_threshold: float | None = None, mode: str = "and", tile: int | None = 256) -> DataFrame:
    """Compose the plan for a method. An external terrain model replaces the minimum filter in
    ``both``; parameter sets that could detect nothing are rejected."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "dtm" and dtm is None:
        raise ValueError("method 'dtm' needs a terrain model")
    if method == "local_min" and dtm is not None:
        raise ValueError("method 'local_min' does not take a terrain model")
    source = freeze(as_tiles(dsm, meta, tile)) if tile is not None and method == "both" else dsm  # read by both branches
    by_slope = lambda: from_slope(source, meta, sigma, slope_threshold, tile)
    if method == "gradient":
        return by_slope()
    if dtm is not None:
        flat = tiles_to_pixels(source, tile).select(*CELL, "v") if "data" in source.columns else source
        height = from_terrain(flat, dtm, height_threshold)
    else:
        height = from_local_min(source, meta, list(windows or [200]), height_threshold, tile)
    return combine(height, by_slope(), mode) if method == "both" else height


def normalise_heights(heights: DataFrame, cap: float) -> DataFrame:
    """``ndsm`` scaled to [0, 1] by the smaller of the 95th positive percentile and ``cap``.

    0 where the surface model (column ``dsm``) is missing; still missing where only the height is.
    """
    as_raster = heights.select("raster_id", F.col("ndsm").alias("v"))
    ceiling = stats.upper_height(as_raster).select(
        "raster_id", F.least(F.coalesce("p95", F.lit(float(cap))), F.lit(float(cap))).alias("_ceil"))
    clipped = F.least(F.greatest(F.col("ndsm"), F.lit(0.0)), F.col("_ceil")) / F.col("_ceil")
    scaled = F.when(F.col("dsm").isNull(), 0.0).when(F.col("ndsm").isNotNull(), clipped)
    return lookup_join(heights, ceiling, "raster_id").withColumn("ndsm_norm", scaled).drop("_ceil")
