"""Masked losses and evaluation metrics over prediction tables.

A prediction table holds ``split, batch_id, logit, target`` (one row per pixel). Everything except
average precision comes from one aggregation to (split, batch, threshold cell); average precision
needs one more aggregation by distinct score.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.pointwise import is_crown, is_valid, predicted, sigmoid
from rasterloom.operators.prefix import prefix_sum
from rasterloom.runtime import freeze

EPS = 1e-6  # fixed value: smoothing of the overlap ratios
# fixed values: the names of the metrics
METRICS = ("loss", "acc", "prec", "rec", "f1", "iou", "soft_iou", "auc_pr")


@dataclass(frozen=True)
class LossWeights:
    bce: float = 0.0
    dice: float = 0.0
    iou: float = 0.0
    mae: float = 0.0
    dice_squared: bool = False


#: A loss term: the pixel-level expressions to sum over valid pixels, and the batch-level loss
#: from those sums (``s["n"]`` is the number of valid pixels).
Term = tuple[Mapping[str, Column], Callable[[Mapping[str, Column]], Column]]


def probability() -> Column:
    return sigmoid(F.col("logit"))


def pixel_sums(x: Column | None = None, t: Column | None = None, p: Column | None = None) -> dict[str, Column]:
    """Expressions whose sums over valid pixels determine every built-in loss."""
    x = F.col("logit") if x is None else x
    t = F.col("target") if t is None else t
    p = F.col("p") if p is None else p
    return {
        "bce": F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))),
        "p": p, "t": t, "pt": p * t, "pp": p * p, "tt": t * t, "abs": F.abs(p - t),
    }


def dice_of(s: Mapping[str, Column], squared: bool = False) -> Column:
    size = s["pp"] + s["tt"] if squared else s["p"] + s["t"]
    return 1.0 - (2.0 * s["pt"] + EPS) / (size + EPS)


def iou_of(s: Mapping[str, Column]) -> Column:
    return 1.0 - (s["pt"] + EPS) / (s["p"] + s["t"] - s["pt"] + EPS)


def loss_terms(weights: LossWeights, extra: Mapping[str, tuple[float, Term]] | None = None):
    """Active terms as name -> (weight, pixel sums, batch loss). Weight 0 switches a term off.

    ``extra`` adds caller-defined terms of the same shape, still plain Column expressions.
    """
    sums = pixel_sums()
    pick = lambda *names: {n: sums[n] for n in names}
    squared = weights.dice_squared
    known: dict[str, tuple[float, Term]] = {
        "bce": (weights.bce, (pick("bce"), lambda s: s["bce"] / s["n"])),
        "dice": (weights.dice, (pick("pt", "pp", "tt") if squared else pick("pt", "p", "t"),
                                lambda s: dice_of(s, squared))),
        "iou": (weights.iou, (pick("pt", "p", "t"), iou_of)),
        "mae": (weights.mae, (pick("abs"), lambda s: s["abs"] / s["n"])),
        **(extra or {}),
    }
    active = {k: v for k, v in known.items() if v[0] > 0}
    if not active:
        raise ValueError("all loss weights are 0")
    return active


def batch_losses(preds: DataFrame, weights: LossWeights, keys: Sequence[str] = ("split", "batch_id"),
                 extra: Mapping[str, tuple[float, Term]] | None = None) -> DataFrame:
    """Combined loss and its weighted parts per batch, with the number of valid pixels.

    A batch without valid pixels has loss 0. Overlap losses are ratios of sums over a whole batch,
    so the batch level cannot be skipped.
    """
    active = loss_terms(weights, extra)
    needed = {n: e for _, (exprs, _f) in active.values() for n, e in exprs.items()}
    valid = is_valid(F.col("target"))
    with_p = preds.withColumn("p", probability())
    total = with_p.groupBy(*keys).agg(
        F.count_if(valid).alias("n"),
        *[F.coalesce(F.sum(F.when(valid, e)), F.lit(0.0)).alias(f"_s_{n}") for n, e in needed.items()])
    s = {n: F.col(f"_s_{n}") for n in needed} | {"n": F.col("n")}
    parts = {name: F.when(F.col("n") > 0, w * f(s)).otherwise(0.0) for name, (w, (_e, f)) in active.items()}
    loss = None
    for c in parts.values():
        loss = c if loss is None else loss + c
    return total.select(*keys, F.col("n").alias("n_valid"), loss.alias("loss"),
                        *[c.alias(f"loss_{name}") for name, c in parts.items()])


def epoch_loss(batches: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Batch losses averaged with their valid pixels as weights; empty batches do not count."""
    parts = [c for c in batches.columns if c == "loss" or c.startswith("loss_")]
    n = F.sum("n_valid")
    return batches.groupBy(*keys).agg(
        n.alias("n_valid"),
        *[F.when(n > 0, F.sum(F.col(c) * F.col("n_valid")) / n).otherwise(0.0).alias(c) for c in parts])


def threshold_table(rows: DataFrame, thresholds: Sequence[float], target_thresholds: Sequence[float]) -> DataFrame:
    """Each row once per (target threshold, prediction threshold); apply to pre-aggregated rows."""
    combos = [F.struct(F.lit(float(tt)).alias("tthr"), F.lit(float(t)).alias("thr"))
              for tt in target_thresholds for t in thresholds]
    return rows.withColumn("_g", F.explode(F.array(*combos))).select(*rows.columns, "_g.tthr", "_g.thr")


def threshold_cells(preds: DataFrame, thresholds: Sequence[float], target_thresholds: Sequence[float],
                    keys: Sequence[str], aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """Pre-aggregation for every threshold pair at once.

    A pixel only matters through how many of the prediction thresholds it reaches and how many of
    the target thresholds it exceeds, so rows collapse to at most (n + 2)(m + 1) cells per key. A pixel
    without a logit reaches neither side of a threshold (NULL).
    """
    p, t = F.col("p"), F.col("target")
    reach = lambda test, values: sum((F.when(test(v), 1).otherwise(0) for v in sorted(set(values))), F.lit(0))
    valid = is_valid(t)
    return (
        preds.withColumn("p", probability())
        .groupBy(*keys, valid.alias("_valid"),
                 F.when(p.isNotNull(), reach(lambda v: predicted(p, v), thresholds)).alias("_rp"),
                 reach(lambda v: is_crown(t, v), target_thresholds).alias("_rt"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(e).alias(n) for n, e in (aggs or {}).items()])
    )


def confusion_from_cells(cells: DataFrame, thresholds: Sequence[float], target_thresholds: Sequence[float],
                         keys: Sequence[str]) -> DataFrame:
    thresholds, target_thresholds = sorted(set(thresholds)), sorted(set(target_thresholds))
    slim = cells.groupBy(*keys, "_valid", "_rp", "_rt").agg(F.sum("_n").alias("_n"))
    ranked = lambda values, col: F.element_at(
        F.create_map(*[x for i, v in enumerate(sorted(values)) for x in (F.lit(float(v)), F.lit(i))]), F.col(col))
    grid = threshold_table(slim, thresholds, target_thresholds)
    pos, truth = F.col("_rp") > ranked(thresholds, "thr"), F.col("_rt") > ranked(target_thresholds, "tthr")
    count = lambda c: F.coalesce(F.sum(F.when(c & F.col("_valid"), F.col("_n"))), F.lit(0).cast("bigint"))
    return grid.groupBy(*keys, "tthr", "thr").agg(
        count(pos & truth).alias("tp"), count(pos & ~truth).alias("fp"),
        count(~pos & truth).alias("fn"), count(~pos & ~truth).alias("tn"))


def confusion(preds: DataFrame, thresholds: Sequence[float], target_thresholds: Sequence[float],
              keys: Sequence[str] = ("split",)) -> DataFrame:
    cells = threshold_cells(preds, thresholds, target_thresholds, keys)
    return confusion_from_cells(cells, thresholds, target_thresholds, keys)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def classification_metrics(conf: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return conf.withColumns({
        "acc": _ratio(tp + tn, tp + fp + fn + tn), "prec": prec, "rec": rec,
        "f1": _ratio(2 * prec * rec, prec + rec), "iou": _ratio(tp, tp + fp + fn)})


def pixel_metrics(preds: DataFrame, threshold: float = 0.5, target_threshold: float = 0.5) -> DataFrame:
    """One row of metrics over the whole table."""
    return classification_metrics(confusion(preds, [threshold], [target_threshold], keys=())).drop("tthr", "thr")


def soft_iou(preds: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    valid, p, t = is_valid(F.col("target")), F.col("p"), F.col("target")
    s = preds.withColumn("p", probability()).groupBy(*keys).agg(
        F.count_if(valid).alias("n"), F.sum(F.when(valid, p * t)).alias("i"),
        F.sum(F.when(valid, p + t - p * t)).alias("u"))
    return s.select(*keys, F.when(F.col("n") > 0, (F.col("i") + EPS) / (F.col("u") + EPS)).otherwise(0.0).alias("soft_iou"))


def average_precision(preds: DataFrame, target_thresholds: Sequence[float], keys: Sequence[str] = ("split",)) -> DataFrame:
    """Area under the precision-recall steps over distinct scores; 0 unless both classes occur.

    Scores are counted first, so equal scores are one step however many pixels share them, and the
    counts get a distributed running total for all target thresholds together.
    """
    keys, target_thresholds = list(keys), list(dict.fromkeys(target_thresholds))
    hits = [f"_p{i}" for i in range(len(target_thresholds))]
    valid = is_valid(F.col("target"))
    by_score = (  # invalid pixels are one NULL score with count 0, which keeps a split without valid pixels
        preds.groupBy(*keys, F.when(valid, probability()).alias("score"))
        .agg(F.count_if(valid).alias("_n"),
             *[F.count_if(valid & is_crown(F.col("target"), float(tt))).alias(h) for h, tt in zip(hits, target_thresholds)])
    )
    steps = prefix_sum(by_score, keys, "score", ["_n", *hits], descending=True)
    precision = lambda h: F.when(F.col("cum__n") > 0, F.col(f"cum_{h}") / F.col("cum__n")).otherwise(0.0)
    sums = steps.groupBy(*keys).agg(
        F.sum("_n").alias("_all"),
        *[F.sum(h).alias(h) for h in hits],
        *[F.sum(F.col(h) * precision(h)).alias(f"_a{h}") for h in hits])
    value = lambda h: F.when((F.col(h) > 0) & (F.col(h) < F.col("_all")), F.col(f"_a{h}") / F.col(h)).otherwise(0.0)
    rows = F.array(*[F.struct(F.lit(float(tt)).alias("tthr"), F.coalesce(value(h), F.lit(0.0)).alias("auc_pr"))
                     for h, tt in zip(hits, target_thresholds)])
    return sums.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.tthr", "_r.auc_pr")


def evaluate(preds: DataFrame, thresholds: Sequence[float], target_thresholds: Sequence[float],
             weights: LossWeights, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Every metric for key (split) x target threshold x prediction threshold, two passes over the pixels.

    A split without a valid pixel keeps its rows, with every metric 0.
    """
    keys, sums = list(keys), pixel_sums()
    cells = freeze(threshold_cells(preds, thresholds, target_thresholds, [*keys, "batch_id"], sums))
    valid = F.col("_valid")
    of = lambda n: F.coalesce(F.sum(F.when(valid, F.col(n))), F.lit(0.0)).alias(f"_s_{n}")
    per_batch = cells.groupBy(*keys, "batch_id").agg(
        F.coalesce(F.sum(F.when(valid, F.col("_n"))), F.lit(0)).alias("n"), *[of(n) for n in sums])
    s = {n: F.col(f"_s_{n}") for n in sums} | {"n": F.col("n")}
    loss = sum((w * f(s) for w, (_e, f) in loss_terms(weights).values()), F.lit(0.0))
    n = F.sum("n")
    per_split = per_batch.groupBy(*keys).agg(
        F.when(n > 0, F.sum(F.when(F.col("n") > 0, loss * F.col("n"))) / n).otherwise(0.0).alias("loss"),
        F.when(n > 0, (F.sum("_s_pt") + EPS) / (F.sum("_s_p") + F.sum("_s_t") - F.sum("_s_pt") + EPS)
               ).otherwise(0.0).alias("soft_iou"))
    conf = classification_metrics(confusion_from_cells(cells, thresholds, target_thresholds, keys))
    ap = average_precision(preds, target_thresholds, keys)
    return conf.join(per_split, keys).join(ap, [*keys, "tthr"]).select(*keys, "tthr", "thr", *METRICS)


def eval_report(evaluation: DataFrame, digits: int = 4) -> DataFrame:
    """Long report: one row per metric and threshold pair, one column per split."""
    long = evaluation.unpivot(["split", "tthr", "thr"], list(METRICS), "metric", "value")
    return (
        long.groupBy("tthr", "thr", "metric").pivot("split", ["train", "val", "test"])
        .agg(F.round(F.first("value"), digits))
    )
