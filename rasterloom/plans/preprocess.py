"""From polygons, an image and a surface model to split patches with channel statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.pointwise import soft_blend
from rasterloom.model import NODATA, list_column, list_rows, pixels_to_tiles, tile_batches
from rasterloom.operators import patches as pt, rasterize, resample, tiles, tilestats
from rasterloom.operators.augment import MASK_CHANNEL
from rasterloom.operators.ground import METHODS
from rasterloom.operators.mosaic import mosaic_image_tiles
from rasterloom.operators.overlay import CELL
from rasterloom.operators.patches import PATCH
from rasterloom.runtime import freeze, lookup_join
from rasterloom.sources.rasters import images_for

TILE_KEY = ["raster_id", "ty", "tx"]


@dataclass(frozen=True)
class PreprocessParams:
    """The defaults of the published configuration."""

    target_gsd: float = 0.05
    sigma: float = 8.0
    nodata_threshold: float = 0.05
    bands: list[int] = field(default_factory=lambda: [5, 4, 6, 7])
    method: str = "both"
    combine: str = "and"
    windows: list[int] = field(default_factory=lambda: [600, 700])
    height_threshold: float = 1.3
    gradient_sigma: float = 2.0
    gradient_threshold: float | None = None
    max_ndsm_height: float = 16.0
    nodata_resolve_threshold: float = 0.6
    patch_size: int = 512
    patch_nodata: float = 0.8
    patch_image_nodata: float = 0.8
    train_ratio: float = 0.7
    val_ratio: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class Preprocessed:
    """Results; ``tiles`` is the written table behind the grids (arrays mask, dsm, ndsm, conf, final per
    patch-sized tile). The pixel grids are views on it; the statistics are planned when first asked for
    and count inside the arrays."""

    tiles: DataFrame
    mask: DataFrame
    heights: DataFrame
    status: DataFrame
    features: DataFrame
    split: DataFrame

    @cached_property
    def channel_stats(self) -> DataFrame:
        """Of the training patches, without the mask channel."""
        return tilestats.channel_stats(self.features.filter(F.col("channel") != MASK_CHANNEL).join(
            self.split.filter("split = 'train'").select("patch_id"), "patch_id", "left_semi"))

    @cached_property
    def audit(self) -> DataFrame:
        return tilestats.blend_audit(self.tiles)

    @cached_property
    def height_summary(self) -> DataFrame:
        return tilestats.height_summary(self.tiles, column="ndsm")

    @cached_property
    def valley(self) -> DataFrame:
        return tilestats.valley_threshold(self.tiles, column="ndsm")


def soften_with_ground(mask: DataFrame, detection: DataFrame, resolve_above: float) -> DataFrame:
    """Every mask cell with the detection's columns and the blended mask ``final``; a cell without
    a detection has confidence 0."""
    grid = mask.select(*CELL, "mask").join(detection, CELL, "left").withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    return grid.withColumn("final", soft_blend(F.col("mask"), F.col("conf"), resolve_above))


def require_same_crs(crowns: DataFrame, *metas: DataFrame | None) -> None:
    """Polygons and rasters with different (or unknown) coordinate systems are an error."""
    codes = crowns.select("crs_epsg")
    for m in metas:
        codes = codes if m is None else codes.unionByName(m.select("crs_epsg"))
    found = [r[0] for r in codes.distinct().limit(2).collect()]
    if len(found) > 1 or found == [None]:
        raise ValueError(f"coordinate systems differ or are unknown: {found}")


def _numpy_blend(p: PreprocessParams, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confidence and blended mask of joined tiles; the formulas of ``functions.pointwise`` on arrays."""
    for batch in batches:
        col = {n: list_rows(batch.column(batch.schema.get_field_index(n))) for n in names}
        out = {"ndsm": [], "conf": [], "final": []}
        scalar = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("scale", "threshold") if n in batch.schema.names}
        for i, mask in enumerate(col["mask"]):
            dsm, confs = col["dsm"][i], []
            there = ~np.isnan(dsm)
            ndsm = dsm - col["low"][i] if "low" in col else np.full(len(dsm), np.nan)
            if "low" in col:
                t = np.clip((ndsm - p.height_threshold) / p.height_threshold, 0, 1)
                confs.append(np.nan_to_num(1 - t * t * (3 - 2 * t), nan=0.0))
            if "slope" in col:
                confs.append(np.where(there, 1 - np.clip(col["slope"][i] / scalar["scale"][i], 0, 1), 0.0))
            conf = (np.maximum if p.combine == "or" else np.minimum).reduce(confs)
            labelled = (mask >= 0) & (mask < NODATA)
            final = np.where(labelled, mask * (1 - conf), np.where((mask == NODATA) & (conf > p.nodata_resolve_threshold), 1 - conf, mask))
            for name, v in (("ndsm", ndsm), ("conf", conf), ("final", final)):
                out[name].append(v)
        lost = [float((f == NODATA).sum()) for f in out["final"]]
        keep = ["raster_id", "ty", "tx", "h", "w", "rh", "rw", "mask", "dsm"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(k)) for k in keep), *map(list_column, out.values()), pa.array(lost)],
            names=[*keep, *out, "n_nodata"])


def _cells(table: DataFrame, size: int, *names: str) -> DataFrame:
    flat = table.select(*TILE_KEY, "w", F.posexplode(F.arrays_zip(*names)).alias("pos", "c"))
    return flat.select("raster_id", F.expr(f"cast(ty as bigint) * {size} + pos div w").alias("y"),
                       F.expr(f"cast(tx as bigint) * {size} + pos % w").alias("x"), *[F.col(f"c.{n}").alias(n) for n in names])


def blended_tiles(mask: DataFrame, dsm: DataFrame, dtm: DataFrame | None, p: PreprocessParams) -> DataFrame:
    """Mask, surface, height, confidence and blended mask, one row of arrays per tile.

    ``both`` takes heights above the terrain model where there is one, else above the minimum filter.
    Layers meet per tile; the slope surface is written once, because its scalars need a pass of their own.
    """
    if p.method not in METHODS:
        raise ValueError(f"unknown method {p.method!r}")
    if p.combine not in ("or", "and"):
        raise ValueError(f"combine mode must be 'or' or 'and', got {p.combine!r}")
    if (p.method == "dtm") != (dtm is not None) and p.method in ("dtm", "local_min"):
        raise ValueError(f"method {p.method!r} and the terrain model do not go together")
    size = p.patch_size
    of = lambda t, name: t.select(*TILE_KEY, F.col("data").alias(name))
    joined = dsm.select(*TILE_KEY, "h", "w", "rh", "rw", F.col("data").alias("dsm")).join(of(mask, "mask"), TILE_KEY)
    names = ["dsm", "mask"]
    if p.method != "gradient":
        low = dtm if dtm is not None else tiles.local_min_surface(dsm, p.windows, size)
        joined, names = joined.join(of(low, "low"), TILE_KEY, "left"), [*names, "low"]
    if p.method in ("gradient", "both"):
        slope = freeze(tiles.smooth_gradient(dsm, p.gradient_sigma, size))
        scalars = tilestats.upper_height(slope).select(
            "raster_id", F.greatest(F.coalesce("p95", F.lit(0.0)), F.lit(1e-8)).alias("scale"))
        joined = lookup_join(joined.join(of(slope, "slope"), TILE_KEY), scalars, "raster_id")
        names = [*names, "slope"]
    arrays = "mask array<double>, dsm array<double>, ndsm array<double>, conf array<double>, final array<double>"
    run = lambda batches: _numpy_blend(p, names, batches)
    return tile_batches(joined).mapInArrow(run, f"raster_id string, ty int, tx int, h int, w int, rh int, rw int, {arrays}, n_nodata double")


def _scaled_heights(blended: DataFrame, cap: float) -> DataFrame:
    """Tiles of heights in [0, 1]: 0 where the surface is missing, missing where only the height is."""
    ceiling = tilestats.upper_height(blended, column="ndsm").select(
        "raster_id", F.least(F.coalesce("p95", F.lit(float(cap))), F.lit(float(cap))).alias("_ceil"))
    scaled = F.zip_with("dsm", "ndsm", lambda d, n: F.when(d.isNull(), 0.0).when(
        n.isNotNull(), F.least(F.greatest(n, F.lit(0.0)), F.col("_ceil")) / F.col("_ceil")))
    return lookup_join(blended, ceiling, "raster_id").withColumn("ndsm_norm", scaled).drop("_ceil")


def preprocess(crowns: DataFrame, image: DataFrame, image_meta: DataFrame, dsm: DataFrame, dsm_meta: DataFrame,
               params: PreprocessParams, dtm: DataFrame | None = None, dtm_meta: DataFrame | None = None,
               reference: str | None = None) -> Preprocessed:
    """Tiles of the patch size from end to end: cells are rows only while polygons are burned and
    pixel inputs are packed (inputs in tile form of that size are taken as they are).

    With ``reference``, the orthomosaics among the images become one mosaic on that raster's grid, the first
    valid cell in the order of their ``priority`` and name; polygons, surface and terrain carry its id.

    Written once, because several later stages read them: the surface on the target grid, the slope
    surface, the blended tiles, the image tiles of patches that pass the mask test, the features.
    """
    p, size = params, params.patch_size
    require_same_crs(crowns, image_meta, dsm_meta, dtm_meta)
    images, frame = (None, image_meta) if reference is None else images_for(image_meta, reference)
    grid = freeze(rasterize.target_grid(frame, p.target_gsd))
    packed = lambda raster, meta: raster if "data" in raster.columns else pixels_to_tiles(
        raster if "band" in raster.columns else raster.withColumn("band", F.lit(1)), meta, size)
    onto_grid = lambda raster, meta: resample.complete(resample.resample_tiles(packed(raster, meta), meta, grid, size, size), grid, size)
    mask = rasterize.mask_tiles(crowns, grid, p.sigma, p.nodata_threshold, size)
    top = freeze(onto_grid(dsm, dsm_meta))
    blended = freeze(blended_tiles(mask, top, None if dtm is None else onto_grid(dtm, dtm_meta), p))

    area = float(size * size)
    shares = blended.select(*TILE_KEY, (F.col("n_nodata") / area).alias("mask_nodata"))
    gate = freeze(shares.filter(F.col("mask_nodata") <= p.patch_nodata))
    shots = packed(image, image_meta)
    bands = freeze(resample.resample_image_tiles(shots, p.bands, image_meta, grid, size, size, wanted=gate) if images is None
                   else mosaic_image_tiles(shots, p.bands, images, grid, size, size, wanted=gate))
    seen = bands.filter("band = 1").select(*TILE_KEY, ((F.lit(int(area)) - F.col("seen")) / area).alias("image_zero"))
    fractions = shares.join(seen, TILE_KEY, "left").select(
        "raster_id", F.col("ty").cast("bigint").alias("pr"), F.col("tx").cast("bigint").alias("pc"), "mask_nodata",
        F.coalesce("image_zero", F.lit(1.0)).alias("image_zero"))
    status = pt.qc_filter(fractions, p.patch_nodata, p.patch_image_nodata)
    named = pt.patch_grid(grid, size).withColumn("patch_id", F.concat_ws("/", "raster_id", "name"))
    kept = freeze(named.join(status.filter("status = 'kept'").select(*PATCH), PATCH))

    heights = _scaled_heights(blended, p.max_ndsm_height)
    layer = lambda table, name, channel: table.select(
        "raster_id", F.lit(channel + 1).alias("band"), "ty", "tx", "h", "w", "rh", "rw", F.col(name).alias("data"))
    stack = bands.drop("seen").unionByName(layer(heights, "ndsm_norm", len(p.bands))).unionByName(layer(blended, "final", MASK_CHANNEL))
    chosen = kept.select("raster_id", F.col("pr").cast("int").alias("ty"), F.col("pc").cast("int").alias("tx"))
    features = freeze(pt.patches_from_tiles(stack.join(chosen, TILE_KEY, "left_semi").select(
        "raster_id", "band", "ty", "tx", "h", "w", "rh", "rw", "data"), size))
    split = pt.split_patches(kept.select("patch_id"), p.train_ratio, p.val_ratio, p.seed).select("patch_id", "split")
    return Preprocessed(
        blended, _cells(blended, size, "final").withColumnRenamed("final", "mask"), _cells(heights, size, "dsm", "ndsm", "ndsm_norm"),
        status, features, split)
