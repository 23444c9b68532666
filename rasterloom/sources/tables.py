"""The test tables seen as rasters, polygons, patches, predictions and histories.

Everything grows with the tables: a raster per return flag covers all order keys as a strip of
72 orders per row, polygons follow suppliers, patches follow vectors, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_PER_ROW = 72
STRIP_WIDTH = 96
PATCH_SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({
        "raster_id": F.col("l_returnflag"),
        "y": F.floor(F.col("l_orderkey") / ORDERS_PER_ROW).cast("bigint"),
        "x": (F.col("l_partkey") % STRIP_WIDTH).cast("bigint"),
    })


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the strips; unit pixels, origin 0."""
    one = F.lit(1.0)
    return _cells(spark, sf_dir).groupBy("raster_id").agg((F.max("y") + 1).alias("height")).select(
        "raster_id", F.lit(32736).alias("crs_epsg"), "height", F.lit(STRIP_WIDTH).cast("bigint").alias("width"),
        F.lit(1).alias("n_bands"), F.lit("float32").alias("dtype"), F.lit(255.0).alias("nodata"),
        (one - 1).alias("x0"), (one - 1).alias("y0"), one.alias("px"), one.alias("py"))


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("raster_id", "y", "x").agg((F.min("l_extendedprice") / 1000).alias("v"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing (NULL) where a cell has no open line."""
    open_qty = F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")))
    return _cells(spark, sf_dir).groupBy("raster_id", "y", "x").agg(
        (F.min("l_extendedprice") / 1000 - open_qty / 17).alias("v"))


def soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    level = (F.sum("l_linenumber") % 10).cast("double") / 10
    return _cells(spark, sf_dir).groupBy("raster_id", "y", "x").agg(
        F.when((n + F.col("y") + F.col("x")) % 4 == 0, 255.0).otherwise(level).alias("mask"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven bands of 16-bit counts."""
    raw = (F.col("l_orderkey") * 37 + F.col("l_suppkey") * 101) % 65536
    return _cells(spark, sf_dir).groupBy(
        "raster_id", (F.col("l_linenumber") % 7 + 1).cast("int").alias("band"), "y", "x").agg(
        F.max(raw).cast("double").alias("v"))


def crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds around supplier positions; some without geometry, without area or not closed."""
    s = table(spark, sf_dir, "supplier")
    k, nat = F.col("s_suppkey"), F.col("s_nationkey")
    cat = F.when(nat % 4 == 0, "son").when(nat % 4 == 1, "soff").when(nat % 4 == 2, "other")
    flags = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    placed = s.select(
        k.alias("crown_id"), F.element_at(flags, (k % 3 + 1).cast("int")).alias("raster_id"),
        cat.alias("crown_category"), F.lit(32736).alias("crs_epsg"),
        (k * 37 % STRIP_WIDTH + 0.25).alias("cx"), (k * 2 + 0.125).alias("cy"),
        (nat % 4 + 2).cast("double").alias("r"))
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(pt(cx - r, cy), pt(cx, cy - r), pt(cx + r, cy), pt(cx, cy + r), pt(cx - r, cy))
    flat = F.array(pt(cx - r, cy), pt(cx, cy), pt(cx + r, cy), pt(cx, cy), pt(cx - r, cy))
    rings = (
        F.when(F.col("crown_id") % 11 == 5, F.lit(None))
        .when(F.col("crown_id") % 13 == 7, F.array(flat))
        .when(F.col("crown_id") % 17 == 3, F.array(F.slice(ring, 1, 4)))
        .otherwise(F.array(ring)))
    return placed.withColumn("rings", rings)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster header per part."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    crs = F.when(size % 5 == 0, 4326).when(size % 5 == 1, 32736).when(size % 5 == 2, 4326).when(size % 5 == 3, 32633)
    tail = F.when(size % 3 == 0, "_OM_shift.tif").when(size % 3 == 1, "_DSM_shift.tif").otherwise("_OM_raw.png")
    px = 0.03 * (1 + size % 3)
    return p.select(
        F.concat(F.lit("scan_"), key.cast("string"), tail).alias("raster_id"), crs.alias("crs_epsg"),
        (100 + size * 7).cast("bigint").alias("height"), (200 + size * 13).cast("bigint").alias("width"),
        F.lit(7).alias("n_bands"), F.lit("uint16").alias("dtype"),
        F.when(size % 2 == 0, 255.0).alias("nodata"),
        (key * 1.5).alias("x0"), F.col("p_retailprice").alias("y0"), px.alias("px"), (-px).alias("py"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths of image, mask and surface patches."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    base = F.concat(F.lit("patches/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("_ms4"))
    keys = lambda cond: li.filter(cond).select(F.col("l_partkey").alias("p_partkey")).distinct()
    named = lambda d, tail: d.select(F.concat(base, F.lit(tail)).alias("path"))
    with_mask = p.join(keys("l_quantity >= 48"), "p_partkey", "left_semi")
    with_dsm = p.join(keys("l_returnflag = 'R' and l_quantity < 8"), "p_partkey", "left_semi")
    return named(p, ".tif").unionByName(named(with_mask, "_mask.tif")).unionByName(named(with_dsm, "_dsm.tif"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five channels of 8 x 8 per patch."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.format_string("p%06d", F.floor(F.col("vec_id") / 5)).alias("patch_id"),
        (F.col("vec_id") % 5).cast("int").alias("channel"), F.lit(PATCH_SIDE).alias("size"),
        F.transform("embedding", lambda v: v.cast("double") + 0.5).alias("data"))


def patch_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft mask of every patch as channel -1, made from its first channel."""
    soft = lambda v: F.when(v < 0.42, 255.0).otherwise(F.least(F.round(v, 2), F.lit(1.0)))
    return patches(spark, sf_dir).filter("channel = 0").select(
        "patch_id", F.lit(-1).alias("channel"), "size", F.transform("data", soft).alias("data"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel per event; every twentieth batch has no valid pixel."""
    return as_predictions(table(spark, sf_dir, "events"))


def as_predictions(events: DataFrame) -> DataFrame:
    k, value = F.col("event_id"), F.col("value")
    digit = k % 10
    batch = F.floor(k / 50)
    target = F.when((F.col("event_type") == "error") | (batch % 20 == 7), 255.0).otherwise(
        (k * 7 % 11).cast("double") / 10)
    return events.select(
        F.floor(k / 5000).alias("run_id"), (F.floor(k % 5000 / 1000) + 1).alias("epoch"),
        F.when(digit < 7, "train").when(digit < 9, "val").otherwise("test").alias("split"),
        batch.alias("batch_id"),
        F.round(F.ln(F.greatest(value, F.lit(0.01)) / 50), 9).alias("logit"), target.alias("target"))


HISTORY_METRICS = ["loss", "val_loss", "f1", "val_f1"]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 64 epochs, one per event, in wide form."""
    k, value = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.floor(k / 64).alias("run_id"), F.lit("tl").alias("phase"), (k % 64 + 1).alias("epoch"),
        (value / 2).alias("loss"), value.alias("val_loss"),
        ((k * 7 % 11).cast("double") / 10).alias("f1"), ((k * 5 % 13).cast("double") / 13).alias("val_f1"))
