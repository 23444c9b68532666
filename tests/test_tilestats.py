"""Tile statistics against numpy and against the pixel forms."""

import numpy as np
import pytest
from helpers import meta_of, pixels_of
from pyspark.sql import functions as F

from rasterloom.model import NODATA, pixels_to_tiles
from rasterloom.operators import patches, selection, stats, tilestats

SIDE = 5


@pytest.fixture(scope="module")
def layers(spark):
    rng = np.random.default_rng(11)
    wide = rng.normal(3, 4, (13, 17))
    wide[rng.random(wide.shape) < 0.2] = np.nan
    wide[0, :4] = [0.0, -0.0, 5e-324, -1e300]
    grids = {"wide": wide, "flat": np.full((4, 6), 2.5), "none": np.full((3, 3), np.nan)}
    meta = meta_of(spark, {k: g.shape for k, g in grids.items()})
    return grids, pixels_of(spark, grids), meta, pixels_to_tiles(pixels_of(spark, grids), meta, SIDE)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or ("raster_id",))).collect()]


@pytest.mark.parametrize("few", [1 << 21, 0])
def test_quantiles_equal_numpy(layers, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    grids, _, _, tiles = layers
    probs = {"low": 0.0, "p10": 0.1, "mid": 0.5, "top": 1.0}
    got = {r.raster_id: r for r in tilestats.quantiles(tiles, ["raster_id"], probs, extremes=True).collect()}
    assert set(got) == set(grids) and all(got["none"][n] is None for n in [*probs, "min", "max"])
    for rid in ("wide", "flat"):
        for name, p in probs.items():
            assert got[rid][name] == pytest.approx(np.nanquantile(grids[rid], p), rel=1e-14)
        assert (got[rid]["min"], got[rid]["max"]) == (np.nanmin(grids[rid]), np.nanmax(grids[rid]))


def test_upper_height_is_of_positive_values(layers):
    grids, _, _, tiles = layers
    got = {r.raster_id: r.p95 for r in tilestats.upper_height(tiles).collect()}
    wide = grids["wide"]
    assert got["wide"] == pytest.approx(np.quantile(wide[wide > 0], 0.95)) and got["none"] is None


def test_ordinals_are_those_of_the_column_function(spark):
    v = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 3.5]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double").orderBy("i").select(
        selection.sortable(F.col("v"))).collect()]
    assert got == tilestats.ordinals(np.array(v)).tolist()


def test_histograms_and_thresholds_equal_the_pixel_forms(layers):
    _, px, _, tiles = layers
    for limits in (None, (0.3, 8.0)):
        assert rows(tilestats.histogram(tiles, bins=9, limits=limits), "raster_id", "bin") == rows(
            stats.histogram(px if limits is None else tiles.select("raster_id", F.explode("data").alias("v")), bins=9, limits=limits), "raster_id", "bin")
    assert rows(tilestats.valley_threshold(tiles)) == rows(stats.valley_threshold(tiles.select("raster_id", F.explode("data").alias("v"))))
    some = px.filter("raster_id <> 'wide' or v > -1e200")
    kept = pixels_to_tiles(some, layers[2], SIDE)
    assert rows(tilestats.otsu_threshold(kept.filter("raster_id <> 'none'"))) == rows(stats.otsu_threshold(some.filter("raster_id <> 'none'")))
    assert tilestats.otsu_threshold(tiles.filter("raster_id = 'none'")).first().threshold is None


def test_otsu_leaves_infinite_values_out(spark):
    data = [1.0, 1.5, float("inf"), 9.0, None, float("-inf")]
    tiles = spark.createDataFrame([("r", data)], "raster_id string, data array<double>")
    px = tiles.select("raster_id", F.explode("data").alias("v"))
    assert tilestats.otsu_threshold(tiles).first() == stats.otsu_threshold(px).first()


def test_counts_and_audit(spark):
    rng = np.random.default_rng(4)
    pick = lambda *v: rng.choice(np.array(v, float), 60)
    mask, conf, final = pick(0, 0.4, 1, NODATA), pick(0, 0.5), pick(0, 0.3, NODATA)
    cut = [(str(i % 2), mask[i:i + 20].tolist(), conf[i:i + 20].tolist(), final[i:i + 20].tolist()) for i in (0, 20, 40)]
    tiles = spark.createDataFrame(cut, "raster_id string, mask array<double>, conf array<double>, final array<double>")
    px = tiles.select("raster_id", F.explode(F.arrays_zip("mask", "conf", "final")).alias("c")).select("raster_id", "c.*")
    assert rows(tilestats.mask_counts(tiles, column="mask")) == rows(stats.mask_counts(px))
    assert rows(tilestats.blend_audit(tiles)) == rows(stats.blend_audit(px))
    assert tilestats.mask_counts(tiles.limit(0), column="mask").count() == 0


def test_channel_stats_far_from_zero(spark):
    """Deviations a billionth of the mean survive; a missing cell counts as 0."""
    rng = np.random.default_rng(5)
    far = 1e6 + rng.normal(0, 1e-3, (4, 50))
    parts = [(0, far[i].tolist()) for i in range(4)] + [(1, [None, 2.0]), (2, [7.0] * 3)]
    got = {r.channel: r for r in tilestats.channel_stats(spark.createDataFrame(parts, "channel int, data array<double>")).collect()}
    assert got[0]["std"] == pytest.approx(far.std(), rel=1e-4) and got[0]["mean"] == pytest.approx(far.mean())
    assert (got[1]["mean"], got[1]["std"]) == (1.0, 1.0) and got[2]["std"] == 1e-6


def test_nodata_fractions_equal_the_pixel_form(spark):
    rng = np.random.default_rng(6)
    shape = {"a": (12, 9), "b": (5, 5)}
    meta = meta_of(spark, shape)
    mask = pixels_of(spark, {k: rng.choice([0.0, 0.5, NODATA], s) for k, s in shape.items()})
    image = pixels_of(spark, {k: rng.choice([0.0, 3.0, np.nan], s) for k, s in shape.items()})
    other = pixels_of(spark, {"a": rng.choice([0.0, 1.0], shape["a"])}, band=4)
    image = image.unionByName(other).filter("not (raster_id = 'a' and y >= 10)")  # the image ends early
    want = patches.nodata_fractions(mask.withColumnRenamed("v", "mask"), image, meta, SIDE)
    got = tilestats.nodata_fractions(pixels_to_tiles(mask, meta, SIDE), pixels_to_tiles(image, meta, SIDE), meta, SIDE)
    order = ("raster_id", "pr", "pc")
    assert rows(got, *order) == rows(want.select(*got.columns), *order)


def test_no_cell_becomes_a_row(layers):
    plan = tilestats.blend_audit(layers[3].select("raster_id", *[F.col("data").alias(n) for n in ("mask", "conf", "final")]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text.split("MapInArrow")[0]
