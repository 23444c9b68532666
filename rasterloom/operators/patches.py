"""Patch grid, quality filter, naming, seeded split, sampling and batching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.hashing import digest
from rasterloom.functions.naming import patch_name
from rasterloom.model import NODATA, PATCH_SCHEMA, list_column, list_rows, tile_batches, tile_grid
from rasterloom.operators.prefix import hash_rank, prefix_sum
from rasterloom.runtime import lookup_join

PATCH = ["raster_id", "pr", "pc"]


def place(pixels: DataFrame, size: int) -> DataFrame:
    """Patch row and column and the position inside the patch of every cell."""
    return pixels.withColumns({
        "pr": F.expr(f"y div {size}"), "pc": F.expr(f"x div {size}"),
        "iy": F.expr(f"cast(y % {size} as int)"), "ix": F.expr(f"cast(x % {size} as int)"),
    })


def patch_grid(meta: DataFrame, size: int) -> DataFrame:
    """Every patch of every raster with its name, its transform and the grid counts."""
    grid = tile_grid(meta, size).select(
        "raster_id", F.col("ty").cast("bigint").alias("pr"), F.col("tx").cast("bigint").alias("pc"),
        F.expr(f"cast(ceil(rh / {size}) as bigint)").alias("n_rows"),
        F.expr(f"cast(ceil(rw / {size}) as bigint)").alias("n_cols"))
    placed = lookup_join(grid, meta.select("raster_id", "x0", "y0", "px", "py"), "raster_id", "inner")
    return placed.select(
        *PATCH, "n_rows", "n_cols",
        patch_name(F.col("pr"), F.col("pc"), F.col("n_rows"), F.col("n_cols")).alias("name"),
        (F.col("x0") + F.col("pc") * size * F.col("px")).alias("left"),
        (F.col("y0") + F.col("pr") * size * F.col("py")).alias("top"),
        "px", "py")


def nodata_fractions(mask: DataFrame, image: DataFrame, meta: DataFrame, size: int) -> DataFrame:
    """Share of sentinel cells and of cells that are 0 in all bands, over the full padded patch.

    Padding counts as mask 0 and image 0, so the denominators are constant and absent image cells
    need no fill. Both inputs are pre-aggregated before they meet the patch grid.
    """
    area = float(size * size)
    m = place(mask, size).groupBy(*PATCH).agg(F.count_if(F.col("mask") == NODATA).alias("_nodata"))
    seen = image.filter("v <> 0").select("raster_id", "y", "x").distinct()
    i = place(seen, size).groupBy(*PATCH).agg(F.count(F.lit(1)).alias("_seen"))
    return (
        tile_grid(meta, size)
        .select("raster_id", F.col("ty").cast("bigint").alias("pr"), F.col("tx").cast("bigint").alias("pc"))
        .join(m, PATCH, "left").join(i, PATCH, "left")
        .select(*PATCH, (F.coalesce("_nodata", F.lit(0)) / area).alias("mask_nodata"),
                ((F.lit(int(area)) - F.coalesce("_seen", F.lit(0))) / area).alias("image_zero"))
    )


def qc_filter(fractions: DataFrame, nodata_threshold: float, image_threshold: float) -> DataFrame:
    """Strictly above a threshold is skipped; the mask test comes first."""
    status = (
        F.when(F.col("mask_nodata") > nodata_threshold, "skipped_mask")
        .when(F.col("image_zero") > image_threshold, "skipped_img")
        .otherwise("kept")
    )
    return fractions.withColumn("status", status)


def pack_patches(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels ``patch_id, channel, iy, ix, v`` to one array per patch and channel, padded with 0."""
    schema = pa.schema([("patch_id", pa.string()), ("channel", pa.int32()), ("size", pa.int32()),
                        ("data", pa.list_(pa.float64()))])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = np.zeros(size * size)
        block[table.column("pos").to_numpy()] = table.column("v").to_numpy().astype(float)
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([size], pa.int32()),
             list_column([block])], schema=schema)

    slim = pixels.select("patch_id", F.col("channel").cast("int").alias("channel"),
                         (F.col("iy") * size + F.col("ix")).cast("int").alias("pos"),
                         F.col("v").cast("double").alias("v"))
    return slim.groupBy("patch_id", "channel").applyInArrow(pack, PATCH_SCHEMA)


def patches_from_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Tiles of side ``size`` as padded patches (``raster_id/name``, band - 1 as channel).

    With the storage tile as large as the patch nothing is shuffled: a tile is a patch.
    """

    def pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for flat, h, w in zip(list_rows(batch.column("data")), batch.column("h").to_pylist(), batch.column("w").to_pylist()):
                block = np.zeros((size, size))
                block[:h, :w] = np.nan_to_num(flat.reshape(h, w), nan=0.0)
                rows.append(block.ravel())
            cols = [batch.column(0), batch.column(1), pa.array([size] * batch.num_rows, pa.int32()), list_column(rows)]
            yield pa.RecordBatch.from_arrays(cols, names=["patch_id", "channel", "size", "data"])

    name = patch_name(F.col("ty"), F.col("tx"), F.ceil(F.col("rh") / size), F.ceil(F.col("rw") / size))
    named = tiles.select(F.concat_ws("/", "raster_id", name).alias("patch_id"),
                         (F.col("band") - 1).alias("channel"), "h", "w", "data")
    return tile_batches(named).mapInArrow(pad, PATCH_SCHEMA)


def unpack_patches(patches: DataFrame) -> DataFrame:
    """One array per patch and channel to pixels ``y, x, v``; narrow."""
    keep = [c for c in patches.columns if c != "data"]
    flat = patches.select(*keep, F.posexplode("data").alias("_p", "v"))
    return flat.select(*keep, F.expr("_p div size").alias("y"), F.expr("cast(_p % size as bigint)").alias("x"), "v")


def split_patches(ids: DataFrame, train: float = 0.7, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Assign every patch to train, val or test with exact sizes ``int(n * ratio)``.

    The order is a seeded digest of the patch id, so it does not depend on how rows arrive.
    """
    if ids.isEmpty():
        raise ValueError("no patches to split")
    ranked = hash_rank(ids, [], digest(seed, F.col("patch_id")), "patch_id")
    n_train = F.floor(F.col("total") * train)
    n_val = F.floor(F.col("total") * val)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("total")


def sample_patches(patches: DataFrame, n: int, split: str) -> DataFrame:
    """The first ``n`` patches of a split by id (a top-n, not a sort)."""
    return patches.filter(F.col("split") == split).orderBy("patch_id").limit(n)


def make_batches(ids: DataFrame, batch_size: int, epoch: int, seed: int, shuffled: tuple[str, ...] = ("train",)) -> DataFrame:
    """Batch numbers per split: a new seeded order every epoch for the shuffled splits, id order
    for the rest. The last batch may be short."""
    mixed = hash_rank(ids.filter(F.col("split").isin(*shuffled)), ["split"],
                      digest(seed, epoch, F.col("patch_id")), "patch_id").drop("total")
    fixed = prefix_sum(ids.filter(~F.col("split").isin(*shuffled)).withColumn("_one", F.lit(1)),
                       ["split"], "patch_id", ["_one"])
    fixed = fixed.withColumn("rank", F.col("cum__one")).drop("_one", "cum__one", "all__one")
    both = mixed.unionByName(fixed.select(*mixed.columns))
    return both.withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size))
