"""Epoch table, stop and best epoch, and dashboard rows of training runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import history as h
from rasterloom.operators import metrics


@dataclass(frozen=True)
class HistoryReport:
    wide: DataFrame
    best: DataFrame
    panels: DataFrame


# The metrics recorded per epoch, besides the parts of the loss.
RECORDED = ("loss", "auc_pr", "f1", "iou", "soft_iou", "prec", "rec")


def epoch_history(preds: DataFrame, weights: metrics.LossWeights, phase: str = "tl", threshold: float = 0.5,
                  target_threshold: float = 0.5) -> DataFrame:
    """Wide history from the predictions of every epoch (run_id, epoch, split, batch_id, ...): the
    recorded metrics at one threshold pair and the parts of the loss for train, the same prefixed
    ``val_`` for val."""
    keys = ["run_id", "epoch", "split"]
    seen = preds.filter(F.col("split").isin("train", "val"))
    parts = metrics.epoch_loss(metrics.batch_losses(seen, weights, [*keys, "batch_id"]), keys).drop("n_valid", "loss")
    scored = metrics.evaluate(seen, [threshold], [target_threshold], weights, keys).select(*keys, *RECORDED)
    per_epoch = scored.join(parts, keys)
    names = [c for c in per_epoch.columns if c not in keys]
    of = lambda split, c, out: F.max(F.when(F.col("split") == split, F.col(c))).alias(out)
    wide = per_epoch.groupBy("run_id", "epoch").agg(
        *[of("train", c, c) for c in names], *[of("val", c, f"val_{c}") for c in names])
    return wide.select("run_id", F.lit(phase).alias("phase"), "epoch", *names, *[f"val_{c}" for c in names])


def history_report(wide: DataFrame, patience: int) -> HistoryReport:
    """Rows up to the stop only, as a run that stopped has no later ones."""
    stops = h.early_stop(wide, patience)
    shown = wide.join(stops.select("run_id", "stop_epoch"), "run_id").filter("epoch <= stop_epoch").drop("stop_epoch")
    return HistoryReport(shown, h.best_epoch(wide, patience), h.metric_panels(shown))
