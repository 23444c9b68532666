"""Equi-joins: raster overlay, band selection, channel statistics, patch triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import naming
from rasterloom.runtime import lookup_join

CELL = ["raster_id", "y", "x"]


def overlay(base: DataFrame, **layers: DataFrame) -> DataFrame:
    """Bring single-band layers onto the base grid; a layer's value column takes the layer's name."""
    renamed = [d.select(*CELL, F.col("v").alias(name)) for name, d in layers.items()]
    return reduce(lambda a, b: a.join(b, CELL, "left"), renamed, base)


def select_bands(raster: DataFrame, bands: list[int]) -> DataFrame:
    """Keep and renumber bands; the output number is the 1-based place in ``bands``.

    A band may be listed twice. The filter on the stored band reaches the scan.
    """
    wanted = sorted(set(bands))
    places = F.create_map(*[
        c for b in wanted for c in (F.lit(b), F.array(*[F.lit(i + 1) for i, x in enumerate(bands) if x == b]))])
    kept = raster.filter(F.col("band").isin(*wanted))
    return kept.withColumn("band", F.explode(F.element_at(places, F.col("band").cast("int"))))


def stack_channels(image: DataFrame, ndsm: DataFrame, key: list[str], n_image: int = 4) -> DataFrame:
    """Image bands become channels 0.. and the height layer the channel after them."""
    img = image.select(*key, (F.col("band") - 1).cast("int").alias("channel"), "y", "x", "v")
    top = ndsm.select(*key, F.lit(n_image).cast("int").alias("channel"), "y", "x", "v")
    return img.unionByName(top)


def zscore(features: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Normalise per channel; ``stats`` has a row per channel of the stack."""
    if stats is None:
        return features
    return lookup_join(features, stats.select("channel", "mean", "std"), "channel", "inner").withColumn("v", (F.col("v") - F.col("mean")) / F.col("std")).drop("mean", "std")


def catalogue(files: DataFrame) -> DataFrame:
    """One row per (folder, stem) with the files of each kind. One shuffle instead of two joins."""
    parsed = files.select(
        F.col("path"), naming.folder(F.col("path")).alias("folder"),
        naming.file_kind(F.col("path")).alias("kind"), naming.triple_stem(F.col("path")).alias("stem"),
    ).filter("kind is not null")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k)
    return parsed.groupBy("folder", "stem").agg(pick("image"), pick("mask"), pick("dsm"))


def find_triples(files: DataFrame) -> DataFrame:
    """Images with both their mask and their surface file in the same folder."""
    return catalogue(files).filter("image is not null and mask is not null and dsm is not null")


def unmatched(files: DataFrame) -> DataFrame:
    """Images without a partner; a missing mask is reported before a missing surface file."""
    c = catalogue(files).filter("image is not null and (mask is null or dsm is null)")
    reason = F.when(F.col("mask").isNull(), "no mask").otherwise("no dsm")
    return c.select("folder", "stem", "image", reason.alias("reason"))
