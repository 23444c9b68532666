"""Logical raster model and its two physical forms.

* pixel form: one row per cell, ``raster_id, band, y, x, v``; a missing cell is NULL or absent.
* tile form: one row per square block, ``data`` row-major with NULL for a missing cell; every tile
  carries the raster's own height and width so edge handling needs no lookup.

Conventions: missing values are NULL inside the engine. NaN is turned into NULL on read, the
no-data sentinel 255 stays a number in soft masks (it takes part in comparisons there).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.runtime import freeze, shuffle_width

NODATA = 255.0

#: Small tiles that lie together share one Python group, up to a block of this side; a call per tile costs more than its cells.
BLOCK_SIDE = 512

#: Cells as rows in one partition.
PART_CELLS = 1 << 20

#: Bytes of tiles that a task's Python holds in one batch, in or out (a single larger tile is one batch).
BATCH_BYTES = 8 << 20

META_SCHEMA = (
    "raster_id string, crs_epsg int, height bigint, width bigint, n_bands int, dtype string, "
    "nodata double, x0 double, y0 double, px double, py double"
)
TILE_SCHEMA = (
    "raster_id string, band int, ty int, tx int, h int, w int, rh int, rw int, data array<double>"
)
PATCH_SCHEMA = "patch_id string, channel int, size int, data array<double>"
PRED_SCHEMA = (
    "split string, batch_id bigint, patch_id string, y int, x int, logit double, target double"
)
HISTORY_SCHEMA = "run_id bigint, phase string, epoch bigint, metric string, value double"


def missing_to_null(c: Column) -> Column:
    """NaN and NULL both mean missing; keep only NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def cell_parts(meta: DataFrame) -> int:
    """Partitions for one row per cell of the rasters in ``meta``: at most ``PART_CELLS`` cells each on
    average, so that a task's memory does not grow with the rasters."""
    total = meta.agg(F.sum(F.col("height") * F.col("width"))).first()[0] or 0
    return max(shuffle_width(meta.sparkSession), -(-int(total) // PART_CELLS))


def cells(meta: DataFrame, parts: int | None = None) -> DataFrame:
    """Every cell of every raster in ``meta``, dealt by raster and row.

    Rows are generated first and spread by number before the columns are generated, so one very
    large raster does not expand inside one task (AQE never coalesces a numbered repartition).
    """
    meta = freeze(meta.select("raster_id", "height", "width"))
    lines = (
        meta.filter("height > 0 and width > 0")
        .select("raster_id", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1)).alias("y"))
        .repartition(parts or cell_parts(meta), "raster_id", "y")
    )
    return lines.select("raster_id", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)).alias("x"))


def densify(pixels: DataFrame, meta: DataFrame, fill: float | None = None) -> DataFrame:
    """Single-band pixels on the complete grid; absent cells get ``fill``. Both sides are dealt by raster and
    row into as many partitions as the grid's size asks for, and the cells are not shuffled again to meet."""
    meta = freeze(meta.select("raster_id", "height", "width"))
    parts = cell_parts(meta)
    found = pixels.select("raster_id", "y", "x", "v").repartition(parts, "raster_id", "y")
    full = cells(meta, parts).join(found, ["raster_id", "y", "x"], "left")
    return full if fill is None else full.withColumn("v", F.coalesce("v", F.lit(float(fill))))


def tile_grid(meta: DataFrame, size: int, bands: tuple[int, ...] = (1,)) -> DataFrame:
    """One row per tile position of every raster (the cell count divided by ``size`` squared)."""
    strips = (
        meta.filter("height > 0 and width > 0")
        .select(
            "raster_id", "height", "width",
            F.explode(F.sequence(F.lit(0), F.expr(f"cast((height - 1) div {size} as int)"))).alias("ty"),
        )
        .repartition(shuffle_width(meta.sparkSession), "raster_id", "ty")
    )
    return strips.select(
        "raster_id",
        F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"),
        "ty",
        F.col("height").cast("int").alias("rh"),
        F.col("width").cast("int").alias("rw"),
        F.explode(F.sequence(F.lit(0), F.expr(f"cast((width - 1) div {size} as int)"))).alias("tx"),
    )


def list_rows(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow list<double> column as float64 arrays (NULL becomes NaN)."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    stops = np.cumsum(arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(flat, stops[:-1].astype(int)) if len(stops) else []


def list_column(rows: list[np.ndarray]) -> pa.Array:
    """The inverse of :func:`list_rows`; NaN becomes NULL."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64(), from_pandas=True))


def tile_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batches to ``BATCH_BYTES`` where they are larger, so that a task's Python
    holds a few megabytes however many tiles the task has; the frame is returned."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def strip_batches(strips: Iterator[tuple[tuple, np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of keys with an array (the schema's last column) as batches of about ``BATCH_BYTES``."""
    keys, parts, held = [], [], 0
    for key, part in strips:
        keys.append(key)
        parts.append(part)
        held += part.nbytes
        if held >= BATCH_BYTES:
            yield _strip_batch(keys, parts, schema)
            keys, parts, held = [], [], 0
    if keys:
        yield _strip_batch(keys, parts, schema)


def _strip_batch(keys: list[tuple], parts: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    lists = [pa.array(v, f.type) for v, f in zip(zip(*keys), schema)]
    return pa.RecordBatch.from_arrays([*lists, list_column(parts)], schema=schema)


def tiles_per_block(size: int) -> int:
    """Tiles of side ``size`` along each axis of a block; at least one."""
    return max(1, BLOCK_SIDE // size)


_TILE_ARROW = pa.schema(
    [("raster_id", pa.string()), ("band", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()),
     ("h", pa.int32()), ("w", pa.int32()), ("rh", pa.int32()), ("rw", pa.int32()),
     ("data", pa.list_(pa.float64()))]
)


def tile_table(ids: dict[str, list], rows: list[np.ndarray]) -> pa.Table:
    """An Arrow table in tile layout from key lists and flat arrays."""
    cols = [pa.array(ids[f.name], f.type) for f in _TILE_ARROW if f.name != "data"]
    return pa.Table.from_arrays([*cols, list_column(rows)], schema=_TILE_ARROW)


def pixels_to_tiles(pixels: DataFrame, meta: DataFrame, size: int, fill: float | None = None,
                    bands: tuple[int, ...] = (1,)) -> DataFrame:
    """Pack pixels into tiles; a group is a block of tiles, at most ``BLOCK_SIDE`` or ``size`` squared cells.

    Only tiles holding at least one pixel are built unless ``fill`` is given, in which case the
    remaining tiles of the grid are added with that constant (NaN adds them as missing) for each of
    ``bands``. Tiles of other bands are kept as they are.
    """
    placeholder = float("nan") if fill is None else float(fill)

    n = tiles_per_block(size)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rid, band, by, bx, rh, rw = (k.as_py() for k in key)
        slots, at = np.unique((table.column("ty").to_numpy() - by * n) * n + table.column("tx").to_numpy() - bx * n, return_inverse=True)
        ty, tx = by * n + slots // n, bx * n + slots % n
        h, w = np.minimum(size, rh - ty * size), np.minimum(size, rw - tx * size)
        stops = np.cumsum(h * w)
        flat = np.full(stops[-1], placeholder)
        val = table.column("v").to_numpy().astype(np.float64)
        flat[(stops - h * w)[at] + table.column("pos").to_numpy()] = np.where(np.isnan(val), placeholder, val)
        m = len(slots)
        ids = dict(raster_id=[rid] * m, band=[band] * m, ty=ty, tx=tx, h=h, w=w, rh=[rh] * m, rw=[rw] * m)
        return tile_table(ids, np.split(flat, stops[:-1]))

    meta = freeze(meta.select("raster_id", "height", "width"))  # read here and for the grid of a fill
    dims = meta.select("raster_id", F.col("height").cast("int").alias("rh"),
                       F.col("width").cast("int").alias("rw"))
    placed = pixels.join(dims, "raster_id").select(
        "raster_id",
        F.col("band").cast("int").alias("band"),
        F.expr(f"cast(y div {size} as int)").alias("ty"),
        F.expr(f"cast(x div {size} as int)").alias("tx"),
        "rh", "rw",
        F.expr(f"cast((y % {size}) * least({size}, rw - (x div {size}) * {size}) + x % {size} as int)").alias("pos"),
        F.col("v").cast("double").alias("v"),
    )
    block = [F.expr(f"{c} div {n}").cast("int").alias(f"_b{c}") for c in ("ty", "tx")]
    tiles = placed.groupBy("raster_id", "band", *block, "rh", "rw").applyInArrow(pack, TILE_SCHEMA)
    return tiles if fill is None else fill_grid(tiles, meta, size, fill, bands)


def fill_grid(tiles: DataFrame, meta: DataFrame, size: int, fill: float, bands: tuple[int, ...] = (1,)) -> DataFrame:
    """The tiles with the grid's other tiles of ``bands`` added, all of one value (NaN: missing)."""
    blank = F.lit(None).cast("double") if np.isnan(fill) else F.lit(float(fill))
    h = F.expr(f"least({size}, rh - ty * {size})")
    w = F.expr(f"least({size}, rw - tx * {size})")
    key = ["raster_id", "band", "ty", "tx"]
    grid = tile_grid(meta, size, bands).withColumn("band", F.col("band").cast("int"))
    have = tiles.select(*key, F.col("rh").alias("_rh"), F.col("rw").alias("_rw"), "data")
    return (
        grid.join(have, key, "full")
        .withColumns({"rh": F.coalesce("rh", "_rh"), "rw": F.coalesce("rw", "_rw")})
        .select(*key, h.alias("h"), w.alias("w"), "rh", "rw", F.coalesce("data", F.array_repeat(blank, h * w)).alias("data"))
    )


def tiles_to_pixels(tiles: DataFrame, size: int | str) -> DataFrame:
    """Unpack tiles of side ``size`` (a number or the name of a column); narrow, no shuffle."""
    side = [size] if isinstance(size, str) else []
    flat = tiles.select("raster_id", "band", "ty", "tx", "w", *side, F.posexplode("data").alias("pos", "v"))
    return flat.select(
        "raster_id", "band",
        F.expr(f"cast(ty as bigint) * {size} + pos div w").alias("y"),
        F.expr(f"cast(tx as bigint) * {size} + pos % w").alias("x"),
        "v",
    )


def zip_tiles(size: int, **layers: DataFrame) -> DataFrame:
    """Several tile tables of one grid as pixels with one column per layer.

    The join is per tile, not per cell; layers missing a tile give NULL.
    """
    key = ["raster_id", "ty", "tx"]
    names = list(layers)
    base, *rest = names
    joined = layers[base].select(*key, "w", F.col("data").alias(base))
    for n in rest:
        joined = joined.join(layers[n].select(*key, F.col("data").alias(n)), key, "left")
    flat = joined.select(*key, "w", F.posexplode(F.arrays_zip(*names)).alias("pos", "c"))
    return flat.select(
        "raster_id",
        F.expr(f"cast(ty as bigint) * {size} + pos div w").alias("y"),
        F.expr(f"cast(tx as bigint) * {size} + pos % w").alias("x"),
        *[F.col(f"c.{n}").alias(n) for n in names],
    )
