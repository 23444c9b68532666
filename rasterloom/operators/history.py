"""Run-history analytics: improvement tracking, early stop, best epoch, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

RUN = ["run_id"]


def early_stop(history: DataFrame, patience: int, keys: list[str] = RUN, block: int = 4096) -> DataFrame:
    """Per run: the epoch training stops at and whether patience ran out.

    An epoch improves when its ``val_loss`` is strictly below every earlier one and below infinity; a
    missing or NaN loss never does. The run stops at the first epoch that is the ``patience``-th one
    recorded after the latest improvement; numbers left out between epochs do not count as waiting.

    Runs are cut into blocks of epochs. A block's rows, its lowest loss and the first place of that are all
    that later blocks need: its last improvement is there, if anywhere. Rows are dealt by block once.
    """
    top = F.lit(float("inf"))
    scope = [*keys, "_blk"]
    inside = W.partitionBy(*scope).orderBy("epoch")
    earlier = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    rows = history.select(
        *keys, "epoch", F.floor(F.col("epoch") / block).alias("_blk"), F.coalesce(F.nanvl("val_loss", top), top).alias("_loss")
    ).withColumns({"_at": F.row_number().over(inside),
                   "_low": F.min("_loss").over(inside.rowsBetween(W.unboundedPreceding, -1))})
    blocks = rows.groupBy(*scope).agg(
        F.max("_at").alias("_n"), F.min("_loss").alias("_least"), F.min(F.struct("_loss", "_at"))["_at"].alias("_first"))
    carry = blocks.withColumns({
        "_past": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_best": F.coalesce(F.min("_least").over(earlier), top),
    }).withColumn("_hit", F.when(F.col("_least") < F.col("_best"), F.col("_past") + F.col("_first")))
    carry = carry.select(*scope, "_past", "_best", F.coalesce(F.max("_hit").over(earlier), F.lit(0)).alias("_seen"))
    placed = rows.join(carry, scope)
    better = F.col("_loss") < F.least(F.coalesce("_low", top), F.col("_best"))
    here = F.max(F.when(better, F.col("_past") + F.col("_at"))).over(inside.rowsBetween(W.unboundedPreceding, 0))
    waited = F.col("_past") + F.col("_at") - F.coalesce(here, F.col("_seen"))
    return placed.withColumn("_waited", waited).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_waited") >= patience, F.col("epoch"))), F.max("epoch")).alias("stop_epoch"),
        F.max(F.col("_waited") >= patience).alias("stopped_early"))


def best_epoch(history: DataFrame, patience: int, keys: list[str] = RUN) -> DataFrame:
    """The epoch whose weights a run ends with: the first lowest loss up to the stop."""
    seen = history.join(early_stop(history, patience, keys), keys).filter("epoch <= stop_epoch")
    return seen.groupBy(*keys).agg(
        F.min_by("epoch", F.struct(F.nanvl("val_loss", F.lit(None).cast("double")).isNull(), "val_loss", "epoch")).alias("best_epoch"),
        F.min(F.nanvl("val_loss", F.lit(None).cast("double"))).alias("best_val_loss"),
        F.first("stop_epoch").alias("stop_epoch"))


def wide_history(history: DataFrame, metrics: list[str], digits: int | None = 8) -> DataFrame:
    """One row per run, phase and epoch with a column per metric. The metric list is given, so no
    extra pass looks for the distinct names."""
    value = F.first("value") if digits is None else F.round(F.first("value"), digits)
    return history.groupBy("run_id", "phase", "epoch").pivot("metric", metrics).agg(value)


def long_history(wide: DataFrame) -> DataFrame:
    fixed = ["run_id", "phase", "epoch"]
    return wide.unpivot(fixed, [c for c in wide.columns if c not in fixed], "metric", "value").filter("value is not null")


def metric_panels(wide: DataFrame, panels: tuple[str, ...] = ("loss", "auc_pr", "f1", "prec", "rec", "iou")) -> DataFrame:
    """Dashboard data (the default panels are fixed values): one row per panel and epoch with the train and val value side by side.

    A metric that was not recorded counts as 0.
    """
    have = set(wide.columns)
    col = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
    rows = F.array(*[F.struct(F.lit(p).alias("panel"), col(p).alias("train"), col(f"val_{p}").alias("val"))
                     for p in panels])
    return wide.select("run_id", "phase", "epoch", F.explode(rows).alias("r")).select("run_id", "phase", "epoch", "r.*")


def evaluation_panels(evaluation: DataFrame,
                      panels: tuple[str, ...] = ("auc_pr", "f1", "iou", "prec", "rec", "acc")) -> DataFrame:
    """Bar-grid data (the default panels are fixed values): metric x thresholds with one column per split, missing splits 0."""
    long = evaluation.unpivot(["split", "tthr", "thr"], list(panels), "metric", "value")
    wide = long.groupBy("metric", "tthr", "thr").pivot("split", ["train", "val", "test"]).agg(F.first("value"))
    return wide.fillna(0.0, ["train", "val", "test"])
