"""Score a model on the split patches and report every metric."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import metrics, patches as pt, scoring
from rasterloom.operators.augment import MASK_CHANNEL
from rasterloom.runtime import freeze, lookup_join


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame
    table: DataFrame
    report: DataFrame
    samples: DataFrame


def normalise_arrays(features: DataFrame, stats: DataFrame | None) -> DataFrame:
    """z-score on stored arrays; channels without statistics stay as they are."""
    if stats is None:
        return features
    return lookup_join(features, stats.select("channel", "mean", "std"), "channel").withColumn(
        "data", F.when(F.col("mean").isNull(), F.col("data")).otherwise(
            F.transform("data", lambda v: (v - F.col("mean")) / F.col("std")))).drop("mean", "std")


def evaluate_model(features: DataFrame, split: DataFrame, stats: DataFrame | None,
                   load: Callable[[], Callable[[np.ndarray], np.ndarray]], thresholds: Sequence[float],
                   target_thresholds: Sequence[float], weights: metrics.LossWeights, batch_size: int = 8,
                   n_samples: int = 6, channels: int = 5) -> Evaluation:
    image = features.filter(F.col("channel") != MASK_CHANNEL)
    masks = features.filter(F.col("channel") == MASK_CHANNEL)
    batches = pt.make_batches(split, batch_size, epoch=0, seed=0, shuffled=())
    logits = scoring.score_patches(normalise_arrays(image, stats), load, channels)
    preds = freeze(scoring.prediction_table(logits, masks, batches.select("patch_id", "split", "batch_id")))
    table = metrics.evaluate(preds, thresholds, target_thresholds, weights)
    chosen = pt.sample_patches(split, n_samples, "val").select("patch_id")
    shown = pt.unpack_patches(image.join(chosen, "patch_id", "left_semi"))
    return Evaluation(preds, table, metrics.eval_report(table),
                      scoring.pseudo_rgb(shown, preds.join(chosen, "patch_id", "left_semi")))


