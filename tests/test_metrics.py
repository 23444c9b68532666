"""Losses and metrics on hand-made logits and targets."""

import math

import numpy as np
import pytest

from rasterloom.operators import metrics as mt


def preds(spark, logits, targets, batch=None, split="val"):
    logits, targets = np.ravel(logits).tolist(), np.ravel(targets).tolist()
    batch = batch or [0] * len(logits)
    return spark.createDataFrame([(split, b, float(x), float(t)) for b, x, t in zip(batch, logits, targets)],
                                 "split string, batch_id bigint, logit double, target double")


def loss(spark, weights, logits, targets):
    return mt.batch_losses(preds(spark, logits, targets), weights).first().loss


KINDS = {"dice": mt.LossWeights(dice=1), "iou": mt.LossWeights(iou=1), "mae": mt.LossWeights(mae=1), "bce": mt.LossWeights(bce=1)}


@pytest.mark.parametrize("kind", KINDS)
def test_perfect_is_low_and_worst_is_high(spark, kind):
    t = np.array([1.0, 0.0] * 8)
    good = loss(spark, KINDS[kind], np.where(t > 0, 20.0, -20.0), t)
    bad = loss(spark, KINDS[kind], np.where(t > 0, -20.0, 20.0), t)
    assert good < 0.01 and bad > 0.9


@pytest.mark.parametrize("kind", KINDS)
def test_all_nodata_is_zero(spark, kind):
    assert loss(spark, KINDS[kind], np.full(16, 5.0), np.full(16, 255.0)) == 0.0


@pytest.mark.parametrize("kind", KINDS)
def test_nodata_pixels_do_not_count(spark, kind):
    x, t = np.array([1.0, -2.0, 0.5]), np.array([0.9, 0.1, 0.4])
    more = loss(spark, KINDS[kind], [*x, 9.0], [*t, 255.0])
    assert more == pytest.approx(loss(spark, KINDS[kind], x, t))


def test_values_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=60), rng.random(60)
    p = 1 / (1 + np.exp(-x))
    i = (p * t).sum()
    assert loss(spark, KINDS["bce"], x, t) == pytest.approx(-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean())
    assert loss(spark, KINDS["dice"], x, t) == pytest.approx(1 - (2 * i + 1e-6) / (p.sum() + t.sum() + 1e-6))
    assert loss(spark, KINDS["iou"], x, t) == pytest.approx(1 - (i + 1e-6) / ((p + t - p * t).sum() + 1e-6))
    assert loss(spark, KINDS["mae"], x, t) == pytest.approx(np.abs(p - t).mean())
    squared = loss(spark, mt.LossWeights(dice=1, dice_squared=True), x, t)
    assert squared == pytest.approx(1 - (2 * i + 1e-6) / ((p * p).sum() + (t * t).sum() + 1e-6))
    assert squared != pytest.approx(loss(spark, KINDS["dice"], x, t))


def test_combined_is_the_weighted_sum(spark):
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=40), rng.random(40)
    parts = 0.5 * loss(spark, KINDS["dice"], x, t) + 0.5 * loss(spark, KINDS["iou"], x, t)
    assert loss(spark, mt.LossWeights(dice=0.5, iou=0.5), x, t) == pytest.approx(parts)
    row = mt.batch_losses(preds(spark, x, t), mt.LossWeights(dice=0.5, iou=0.5)).first().asDict()
    assert row["loss"] == pytest.approx(row["loss_dice"] + row["loss_iou"]) and "loss_bce" not in row


def test_zero_weights_raise():
    with pytest.raises(ValueError, match="all loss weights are 0"):
        mt.loss_terms(mt.LossWeights())


def test_known_iou(spark):
    m = mt.pixel_metrics(preds(spark, [5, 5, 5, -5], [1, 1, 0, 1])).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 0)
    assert m.iou == pytest.approx(0.5)


def test_perfect_metrics(spark):
    m = mt.pixel_metrics(preds(spark, [5, -5, 5, -5], [1, 0, 1, 0])).first()
    assert (m.acc, m.prec, m.rec, m.f1, m.iou) == (1, 1, 1, 1, 1)


def test_threshold_effect(spark):
    d = preds(spark, [1.0] * 4, [1.0] * 4)
    assert mt.pixel_metrics(d, threshold=0.5).first().f1 == 1.0
    assert mt.pixel_metrics(d, threshold=0.8).first().f1 == 0.0


def test_average_precision_extremes(spark):
    t = [1] * 8 + [0] * 8
    best = preds(spark, [5.0 - i / 10 for i in range(16)], t)
    assert mt.average_precision(best, [0.5]).first().auc_pr == pytest.approx(1.0)
    worst = preds(spark, [-5.0] + [5.0 - i / 10 for i in range(15)], [1] + [0] * 15)
    assert mt.average_precision(worst, [0.5]).first().auc_pr < 0.2


def test_average_precision_ties_are_one_step(spark):
    d = preds(spark, [1.0, 1.0, 0.0, 0.0], [1, 0, 1, 0])
    assert mt.average_precision(d, [0.5]).first().auc_pr == pytest.approx(0.5 * 0.5 + 0.5 * 0.5)


def test_average_precision_needs_both_classes(spark):
    assert mt.average_precision(preds(spark, [1, 2], [1, 1]), [0.5]).first().auc_pr == 0.0


def test_epoch_loss_is_weighted_and_skips_empty(spark):
    b = spark.createDataFrame([("val", 2.0, 2), ("val", 4.0, 2), ("val", 99.0, 0)], "split string, loss double, n_valid bigint")
    assert mt.epoch_loss(b).first().loss == pytest.approx(3.0)
    b = spark.createDataFrame([("val", 1.0, 30), ("val", 4.0, 10)], "split string, loss double, n_valid bigint")
    assert mt.epoch_loss(b).first().loss == pytest.approx(1.75)


def test_all_nodata_split_keeps_its_rows(spark):
    d = preds(spark, [1.0] * 4, [255.0] * 4, split="test").union(preds(spark, [1.0, -1.0], [1.0, 0.0], split="val"))
    rows = {r.split: r for r in mt.evaluate(d, [0.5], [0.5], mt.LossWeights(bce=1)).collect()}
    assert all(rows["test"][m] == 0 for m in mt.METRICS)
    assert rows["val"].f1 == 1.0 and rows["val"].soft_iou > 0


def test_one_hot_score_and_hot_split(spark):
    """Most pixels share one score and one split; counts must stay whole."""
    n = 3000
    d = preds(spark, [0.3] * n + [2.0, -2.0], [1.0, 0.0] * (n // 2) + [1.0, 0.0])
    got = mt.average_precision(d, [0.5]).first().auc_pr
    pos = n // 2 + 1
    want = (1 * 1 + (n // 2) * ((1 + n // 2) / (1 + n))) / pos
    assert got == pytest.approx(want)
    c = mt.confusion(d, [0.5], [0.5]).first()
    assert c.tp + c.fp + c.fn + c.tn == n + 2
    assert math.isclose(c.tp, pos)


def test_pixels_without_logit_are_neither_found_nor_missed(spark):
    rows = [("val", 0, 2.0, 1.0), ("val", 0, -2.0, 1.0), ("val", 0, None, 1.0), ("val", 0, None, 0.0), ("val", 0, None, 255.0)]
    preds = spark.createDataFrame(rows, "split string, batch_id bigint, logit double, target double")
    c = mt.confusion(preds, [0.5], [0.5]).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 0, 1, 0)
