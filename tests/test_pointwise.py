"""Blend, confidence and sentinel rules on single values."""

import math

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import pointwise as pw


def one(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col.alias("o")).first()["o"]


def blend(spark, mask, conf, thr=0.7):
    return one(spark, "m double, c double", (mask, conf), pw.soft_blend(F.col("m"), F.col("c"), thr))


@pytest.mark.parametrize("mask,conf,want", [
    (0.8, 0.0, 0.8), (0.8, 1.0, 0.0), (0.8, 0.5, 0.4), (0.0, 0.9, 0.0), (0.6, 0.4, 0.36),
    (255.0, 0.0, 255.0), (255.0, 0.5, 255.0), (255.0, 0.7, 255.0), (255.0, 0.8, 0.2), (255.0, 1.0, 0.0)])
def test_soft_blend(spark, mask, conf, want):
    assert blend(spark, mask, conf) == pytest.approx(want)


def test_blend_stays_in_range(spark):
    rows = [(m / 10, c / 10) for m in range(11) for c in range(11)] + [(255.0, c / 10) for c in range(11)]
    d = spark.createDataFrame(rows, "m double, c double").select(pw.soft_blend(F.col("m"), F.col("c"), 0.7).alias("o"))
    assert all(0 <= r.o <= 1 or r.o == 255 for r in d.collect())


@pytest.mark.parametrize("ndsm,want", [(0.0, 1), (1.0, 1), (2.0, 1), (3.0, 0.5), (4.0, 0), (10.0, 0), (-3.0, 1), (None, 0)])
def test_height_confidence(spark, ndsm, want):
    assert one(spark, "h double", (ndsm,), pw.height_confidence(F.col("h"), 2.0)) == pytest.approx(want)


def test_confidence_falls_monotonically(spark):
    d = spark.range(0, 50).select((F.col("id") / 10).alias("h")).select("h", pw.height_confidence(F.col("h"), 2.0).alias("c"))
    c = [r.c for r in d.orderBy("h").collect()]
    assert all(a >= b for a, b in zip(c, c[1:]))


@pytest.mark.parametrize("v,want", [(None, 0.0), (float("nan"), 0.0), (1.5, 1.5), (float("inf"), pw.FLOAT_MAX),
                                    (float("-inf"), -pw.FLOAT_MAX)])
def test_fill_missing(spark, v, want):
    assert one(spark, "v double", (v,), pw.fill_missing(F.col("v"))) == want


def test_scale_to_unit(spark):
    assert one(spark, "v double", (65535.0,), pw.scale_to_unit(F.col("v"))) == 1.0
    assert one(spark, "v double", (float("nan"),), pw.scale_to_unit(F.col("v"))) == 0.0


@pytest.mark.parametrize("x", [-800.0, -3.0, 0.0, 2.5, 800.0])
def test_sigmoid_is_stable(spark, x):
    want = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    assert one(spark, "x double", (x,), pw.sigmoid(F.col("x"))) == pytest.approx(want)


def test_merge_modes(spark):
    a, b = F.lit(0.2), F.lit(0.9)
    d = spark.range(1).select(pw.merge_confidence(a, b, "or").alias("o"), pw.merge_confidence(a, b, "and").alias("n")).first()
    assert (d.o, d.n) == (0.9, 0.2)
    with pytest.raises(ValueError):
        pw.merge_confidence(a, b, "xor")


def test_thresholds_are_inclusive_and_strict(spark):
    d = spark.range(1).select(pw.predicted(F.lit(0.5), 0.5).alias("p"), pw.is_crown(F.lit(0.5), 0.5).alias("t")).first()
    assert d.p and not d.t
