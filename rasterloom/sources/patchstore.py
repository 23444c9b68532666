"""Patch sets, splits and channel statistics on disk."""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATS_SCHEMA = "channel int, mean double, std double"


def kind() -> Column:
    return F.when(F.col("channel") == -1, "mask").when(F.col("channel") == 4, "dsm").otherwise("image")


def write_patches(patches: DataFrame, path: str) -> None:
    """Patch arrays by kind (image, mask, dsm); an existing set is replaced."""
    (
        patches.withColumn("kind", kind()).repartition("kind", "patch_id")
        .write.mode("overwrite").partitionBy("kind").parquet(path)
    )


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_split(patches: DataFrame, assignment: DataFrame, path: str, mode: str = "copy") -> None:
    """``copy`` writes the patches by split; ``symlink`` writes the assignment only and the
    patches are joined on read. ``assignment`` holds patch_id and split."""
    slim = assignment.select("patch_id", "split")
    if mode == "copy":
        out = patches.join(slim, "patch_id")
    elif mode == "symlink":
        out = slim
    else:
        raise ValueError(f"mode must be 'copy' or 'symlink', got {mode!r}")
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, patches: DataFrame | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored if patches is None else patches.join(stored.select("patch_id", "split"), "patch_id")


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON line per channel (a handful of rows)."""
    stats.select("channel", "mean", "std").coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored statistics, or None with a warning when there are none."""
    try:
        return spark.read.schema(STATS_SCHEMA).json(path)
    except (AnalysisException, Py4JJavaError):
        warnings.warn(f"no channel statistics at {path}: features stay unnormalised", stacklevel=2)
        return None
