"""Several images on one grid: every image is resampled, then the first valid cell wins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rasterloom.model import TILE_SCHEMA, list_rows, tile_table
from rasterloom.operators.overlay import select_bands
from rasterloom.operators.resample import resample_tiles, unit_image
from rasterloom.runtime import freeze, lookup_join

#: Images whose tiles one task lays over each other at once.
FAN = 16


def placed_images(images: DataFrame) -> DataFrame:
    """The headers with ``slot``, the image's place in its grid's order from 0: ``priority`` (if there is such
    a column; lower first, missing last), then name. One narrow row per image is ordered, no raster."""
    first = [F.col("priority").asc_nulls_last()] if "priority" in images.columns else []
    order = W.partitionBy("grid_id").orderBy(*first, "raster_id")
    return images.withColumn("slot", (F.row_number().over(order) - 1).cast("long"))


def mosaic_tiles(tiles: DataFrame, images: DataFrame, grids: DataFrame, size: int, out_size: int,
                 wanted: DataFrame | None = None, seen: bool = False, fan: int = FAN) -> DataFrame:
    """Tiles of many images as one raster per grid: in every cell and band the value of the first image, in
    the order of :func:`placed_images`, that has one there after resampling.

    ``images`` are headers with ``grid_id``, the id of a header in ``grids``; ids are unique in both, images
    without a known grid take no part. Taking the first valid cell is associative, so tiles meet in rounds of at most
    ``fan`` neighbours in the order: a place photographed thousands of times is never gathered in one
    task. Grid tiles that no image reaches are absent. ``wanted`` (grid's raster_id, ty, tx) limits the tiles,
    ``seen`` counts the cells that are neither missing nor 0 in some band.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    listed = freeze(placed_images(images.join(grids.select(F.col("raster_id").alias("grid_id")), "grid_id", "left_semi")))
    target = listed.select("raster_id", "grid_id").join(grids.withColumnRenamed("raster_id", "grid_id"), "grid_id")
    moved = resample_tiles(tiles, listed, target, size, out_size, wanted, home=listed)
    layers = lookup_join(moved, listed.select("raster_id", "grid_id", "slot"), "raster_id", "inner").withColumn("raster_id", F.col("grid_id"))
    top = listed.agg(F.max("slot")).first()[0] or 0

    def lay(count_seen: bool):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            rid, ty, tx, group = (k.as_py() for k in key)
            table = table.sort_by([("band", "ascending"), ("slot", "ascending")])
            out: dict[int, np.ndarray] = {}
            for band, flat in zip(table.column("band").to_pylist(), list_rows(table.column("data"))):
                out[band] = np.where(np.isnan(out[band]), flat, out[band]) if band in out else flat
            n = len(out)
            of = lambda c: [table.column(c)[0].as_py()] * n
            ids = dict(raster_id=[rid] * n, band=list(out), ty=[ty] * n, tx=[tx] * n, **{c: of(c) for c in ("h", "w", "rh", "rw")})
            packed = tile_table(ids, list(out.values())).append_column("slot", pa.array([group] * n, pa.int64()))
            if not count_seen:
                return packed
            some = np.any([np.nan_to_num(v) != 0 for v in out.values()], axis=0)
            return packed.append_column("seen", pa.array([int(some.sum())] * n, pa.int64()))
        return run

    names = [c.split()[0] for c in TILE_SCHEMA.split(", ")]
    layers = layers.select(*names, "slot")
    while True:
        last = top < fan
        layers = layers.groupBy("raster_id", "ty", "tx", F.expr(f"slot div {fan}").alias("_group")).applyInArrow(
            lay(last and seen), TILE_SCHEMA + ", slot bigint" + (", seen bigint" if last and seen else ""))
        top //= fan
        if last:
            return layers.drop("slot")


def mosaic_image_tiles(tiles: DataFrame, bands: list[int], images: DataFrame, grids: DataFrame, size: int, out_size: int,
                       top: float = 65535.0, wanted: DataFrame | None = None) -> DataFrame:
    """Picked bands of many images as one image per grid on all its tiles (or those wanted), scaled to [0, 1];
    cells that no image covers are 0. With the column ``seen``."""
    moved = mosaic_tiles(select_bands(tiles, bands), images, grids, size, out_size, wanted, seen=True)
    return unit_image(moved, grids, len(bands), out_size, top, wanted)
