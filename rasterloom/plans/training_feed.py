"""The per-epoch feed of training, validation and test patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.pointwise import fill_missing
from rasterloom.operators import augment as aug
from rasterloom.operators.patches import make_batches
from rasterloom.plans.evaluation import normalise_arrays


def training_feed(features: DataFrame, split: DataFrame, stats: DataFrame | None, epoch: int, seed: int,
                  batch_size: int = 8, ranges: aug.Ranges = aug.Ranges(), augmented: bool = True) -> DataFrame:
    """Arrays per patch and channel with split and batch number.

    Missing image values become 0, training patches are augmented anew every epoch, and channels
    are normalised after that. The mask (channel -1) is only moved, never rescaled.
    """
    filled = features.withColumn("data", F.when(F.col("channel") == aug.MASK_CHANNEL, F.col("data")).otherwise(
        F.transform("data", fill_missing)))
    batches = make_batches(split, batch_size, epoch, seed).select("patch_id", "split", "batch_id")
    placed = filled.join(batches, "patch_id")
    train = aug.augment(placed.filter("split = 'train'"), epoch, seed, ranges, augmented)
    rest = placed.filter("split <> 'train'")
    return normalise_arrays(train.unionByName(rest), stats)
