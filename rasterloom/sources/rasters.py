"""Raster tables on Parquet: tile layout, partitioned by raster and band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.naming import RASTER_EXT
from rasterloom.model import NODATA, TILE_SCHEMA, missing_to_null, pixels_to_tiles, tiles_to_pixels

# How orthomosaic files are recognised.
MOSAIC_TAG = "_OM_"
#: Band of each detection method in a confidence store.
METHOD_BANDS = {"local_min": 1, "dtm": 2, "gradient": 3, "both": 4}
_LAYOUT = "ty int, tx int, h int, w int, rh int, rw int, side int, data array<float>, raster_id string, band int"


def write_raster(tiles: DataFrame, path: str, size: int, nodata: float | None = None, per_side: int = 16) -> None:
    """Tiles of side ``size`` as float32 rows which also hold the side. With ``nodata`` the sentinel is
    written for missing cells.

    Squares of ``per_side`` tiles a side are the unit of writing, so one large raster is written by
    many tasks whatever its shape; tiles are ordered inside a file so that row-group statistics on
    ``ty, tx`` prune windows.
    """
    value = lambda v: (v if nodata is None else F.coalesce(v, F.lit(float(nodata)))).cast("float")
    out = tiles.withColumns({"data": F.transform("data", value), "side": F.lit(size)})
    (
        out.repartition("raster_id", "band", F.expr(f"ty div {per_side}"), F.expr(f"tx div {per_side}")).sortWithinPartitions("raster_id", "band", "ty", "tx")
        .write.mode("overwrite").partitionBy("raster_id", "band").parquet(path)
    )


def read_tiles(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """Tiles of all or some bands; the band list prunes partitions."""
    return _stored(spark, path, bands).drop("side")


def _stored(spark: SparkSession, path: str, bands: list[int] | None) -> DataFrame:
    t = spark.read.schema(_LAYOUT).parquet(path)
    if bands:
        t = t.filter(F.col("band").isin(*bands))
    names = [c.split()[0] for c in TILE_SCHEMA.split(", ")]
    return t.select(*names[:-1], F.transform("data", missing_to_null).alias("data"), "side")


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, nodata: float | None = None) -> DataFrame:
    """Pixels of all or some bands as doubles; NaN and, if given, the sentinel become missing. The tile
    side comes from the stored rows."""
    px = tiles_to_pixels(_stored(spark, path, bands), "side")
    return px if nodata is None else px.withColumn("v", F.nullif("v", F.lit(float(nodata))))


def read_pixels(pixels: DataFrame, bands: list[int] | None = None) -> DataFrame:
    """The same contract for a table already in pixel form: band filter, doubles, NaN missing."""
    kept = pixels.filter(F.col("band").isin(*bands)) if bands else pixels
    return kept.withColumn("v", missing_to_null(F.col("v")))


def raster_info(meta: DataFrame) -> DataFrame:
    """CRS, shape, type, bounds and no-data value per raster."""
    far_x, far_y = F.col("x0") + F.col("width") * F.col("px"), F.col("y0") + F.col("height") * F.col("py")
    return meta.select(
        "raster_id", F.concat(F.lit("EPSG:"), F.col("crs_epsg").cast("string")).alias("crs"),
        "n_bands", "height", "width", "dtype",
        F.least("x0", far_x).alias("left"), F.least("y0", far_y).alias("bottom"),
        F.greatest("x0", far_x).alias("right"), F.greatest("y0", far_y).alias("top"), "nodata")


def check_crs(meta: DataFrame, epsg: int = 4326) -> DataFrame:
    """Flag rasters in another (or no) coordinate system."""
    return meta.withColumn("crs_ok", F.col("crs_epsg").eqNullSafe(F.lit(epsg)))


def select_images(meta: DataFrame, reference: str | None = None) -> DataFrame:
    """Orthomosaics by name, or only the reference raster when one is named."""
    name = F.col("raster_id")
    if reference is not None:
        return meta.filter(name == reference)
    return meta.filter(name.contains(MOSAIC_TAG) & name.endswith(RASTER_EXT))


def images_for(meta: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    """The orthomosaics with the grid they go to (``grid_id``), and the reference's own header."""
    return select_images(meta).withColumn("grid_id", F.lit(reference)), select_images(meta, reference)


def write_mask(tiles: DataFrame, path: str, size: int) -> None:
    write_raster(tiles, path, size, nodata=NODATA)


def write_confidence(confidence: DataFrame, meta: DataFrame, path: str, size: int = 256) -> None:
    """Ground confidence (``method, raster_id, y, x, conf``) as one band per detection method, in tile
    layout, no sentinel."""
    number = F.create_map(*[c for m, b in METHOD_BANDS.items() for c in (F.lit(m), F.lit(b))])
    known = confidence.select("raster_id", F.element_at(number, F.col("method")).alias("band"), "y", "x", F.col("conf").alias("v"))
    write_raster(pixels_to_tiles(known, meta, size), path, size)


def read_confidence(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    """(method, raster_id, y, x, conf); cells that were not written are missing."""
    name = F.create_map(*[c for m, b in METHOD_BANDS.items() for c in (F.lit(b), F.lit(m))])
    px = read_raster(spark, path, [METHOD_BANDS[m] for m in methods] if methods else None)
    return px.select(F.element_at(name, F.col("band")).alias("method"), "raster_id", "y", "x", F.col("v").alias("conf"))


def write_heights(heights: DataFrame, meta: DataFrame, path: str, size: int = 256) -> None:
    """Heights in metres in tile layout; missing stays missing."""
    known = heights.select("raster_id", F.lit(1).alias("band"), "y", "x", F.col("ndsm").alias("v"))
    write_raster(pixels_to_tiles(known, meta, size), path, size)


def read_heights(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, y, x, ndsm) of the tiles that hold a cell."""
    return read_raster(spark, path).select("raster_id", "y", "x", F.col("v").alias("ndsm"))
