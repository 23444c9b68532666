"""Patch grid, split, batches, augmentation, history and stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import grid_of, meta_of, pixels_of
from rasterloom.functions import naming
from rasterloom.model import pixels_to_tiles
from rasterloom.operators import augment as aug, history as hi, patches as pt
from rasterloom.sources import patchstore, rasters, runstore


def test_padding_and_names(spark):
    g = np.arange(35.0).reshape(5, 7) + 1
    meta = meta_of(spark, {"r": g.shape}, px=0.5, py=-0.5, x0=10.0, y0=20.0)
    got = {r.patch_id: np.array(r.data).reshape(4, 4)
           for r in pt.patches_from_tiles(pixels_to_tiles(pixels_of(spark, {"r": g}), meta, 4), 4).collect()}
    assert sorted(got) == ["r/0_0_ms4", "r/0_1_ms4", "r/1_0_ms4", "r/1_1_ms4"]
    np.testing.assert_array_equal(got["r/1_1_ms4"], np.pad(g[4:, 4:], ((0, 3), (0, 1))))
    corner = pt.patch_grid(meta, 4).filter("pr = 1 and pc = 1").first()
    assert (corner.left, corner.top) == (12.0, 18.0)


def test_name_width_follows_counts(spark):
    row = spark.createDataFrame([(3, 7, 10, 100)], "r int, c int, n int, m int").select(
        naming.patch_name(F.col("r"), F.col("c"), F.col("n"), F.col("m")).alias("s")).first()
    assert row.s == "03_007_ms4"


def test_qc_thresholds_are_strict_and_mask_comes_first(spark):
    d = spark.createDataFrame([(0.8, 0.8), (0.81, 0.9), (0.1, 0.81)], "mask_nodata double, image_zero double")
    assert [r.status for r in pt.qc_filter(d, 0.8, 0.8).collect()] == ["kept", "skipped_mask", "skipped_img"]


@pytest.mark.parametrize("n", [1, 7, 10, 123])
def test_split_sizes(spark, n):
    ids = spark.range(n).select(F.format_string("p%d", "id").alias("patch_id"))
    got = {r.split: r["count"] for r in pt.split_patches(ids, 0.7, 0.2, 42).groupBy("split").count().collect()}
    assert got.get("train", 0) == int(n * 0.7) and got.get("val", 0) == int(n * 0.2)
    assert sum(got.values()) == n


def test_split_depends_on_seed_only(spark):
    ids = spark.range(60).select(F.format_string("p%d", "id").alias("patch_id"))
    run = lambda d, seed: {r.patch_id: r.split for r in pt.split_patches(d, seed=seed).collect()}
    assert run(ids, 1) == run(ids.orderBy(F.rand(3)), 1) != run(ids, 2)


def test_empty_split_raises(spark):
    with pytest.raises(ValueError, match="no patches"):
        pt.split_patches(spark.createDataFrame([], "patch_id string"))


def test_batches_reshuffle_training_only(spark):
    ids = spark.range(21).select(F.format_string("p%02d", "id").alias("patch_id"),
                                 F.when(F.col("id") < 13, "train").otherwise("val").alias("split"))
    run = lambda e: {r.patch_id: r.batch_id for r in pt.make_batches(ids, 4, e, 9).collect()}
    a, b = run(0), run(1)
    train = [f"p{i:02d}" for i in range(13)]
    assert [a[p] for p in train] != [b[p] for p in train]
    assert sorted(a[p] for p in train) == [0] * 4 + [1] * 4 + [2] * 4 + [3]
    assert [a[f"p{i}"] for i in range(13, 21)] == [0] * 4 + [1] * 4 == [b[f"p{i}"] for i in range(13, 21)]


# augmentation -----------------------------------------------------------------------------------
SIZE = 12


@pytest.fixture(scope="module")
def arrays(spark):
    rng = np.random.default_rng(11)
    rows = []
    for p in range(40):
        for c in range(-1, 3):
            a = rng.random(SIZE * SIZE)
            if c == -1:
                a = np.where(a < 0.2, 255.0, a)
            rows.append((f"p{p:03d}", c, SIZE, a.tolist()))
    return spark.createDataFrame(rows, "patch_id string, channel int, size int, data array<double>").cache()


def cube(df):
    return {(r.patch_id, r.channel): np.array(r.data).reshape(SIZE, SIZE) for r in df.collect()}


def test_geometric_is_a_square_symmetry_shared_by_all_channels(arrays):
    off = aug.Ranges(distort=0, tone=0, gamma=0, gain=0, noise=0, blur=0, dropout=0)
    src, out = cube(arrays), cube(aug.augment(arrays, 1, 5, off))
    seen = set()
    for p in range(40):
        fits = None
        for c in range(-1, 3):
            a, b = src[f"p{p:03d}", c], out[f"p{p:03d}", c]
            cands = {(k, t) for k in range(4) for t in (0, 1) if np.array_equal(np.rot90(a.T if t else a, k), b)}
            fits = cands if fits is None else fits & cands
        assert len(fits) == 1
        seen |= fits
    assert len(seen) == 8


def test_array_form_equals_pixel_form(spark, arrays):
    ranges = aug.Ranges(distort=0, hole_size=(3, 6))
    out = cube(aug.augment(arrays, 2, 5, ranges))
    drawn = aug.with_draws(arrays, 2, 5, ranges)
    px = pt.unpack_patches(drawn)
    px = aug.noise(aug.gain(aug.gamma(aug.tone(aug.turn(aug.flip(px))))))
    soft = aug.blur(px).join(drawn.select("patch_id", "channel", "draw"), ["patch_id", "channel"])
    final = aug.dropout(soft)
    for r in final.select("patch_id", "channel", "y", "x", "v").collect():
        assert out[r.patch_id, r.channel][int(r.y), int(r.x)] == pytest.approx(r.v, abs=1e-9)


def test_distortion_keeps_sentinel_and_range(arrays):
    only = aug.Ranges(flip=0, rotate=0, transpose=0, distort=1, tone=0, gamma=0, gain=0, noise=0, blur=0, dropout=0)
    src, out = cube(arrays), cube(aug.augment(arrays, 0, 5, only))
    for key, b in out.items():
        if key[1] == -1:  # a small warp may leave every nearest cell in place
            assert set(np.unique(b)) <= set(np.unique(src[key]))
        else:
            assert not np.array_equal(b, src[key])
            assert b.min() >= src[key].min() - 1e-12 and b.max() <= src[key].max() + 1e-12


def test_noise_is_normal_and_repeatable(spark):
    big = spark.createDataFrame([(f"p{i}", 0, 64, [0.5] * 4096) for i in range(8)],
                                "patch_id string, channel int, size int, data array<double>")
    only = aug.Ranges(flip=0, rotate=0, transpose=0, distort=0, tone=0, gamma=0, gain=0, noise=1, blur=0, dropout=0,
                      noise_range=(0.01, 0.01))
    run = lambda e: np.concatenate([np.array(r.data) for r in aug.augment(big, e, 3, only).orderBy("patch_id").collect()])
    a = run(0)
    assert abs(a.mean() - 0.5) < 5e-4 and abs(a.std() - 0.01) < 3e-4
    np.testing.assert_array_equal(a, run(0))
    assert not np.array_equal(a, run(1))


def test_disabled_augmentation_passes_through(arrays):
    assert aug.augment(arrays, 0, 0, enabled=False) is arrays


# history ----------------------------------------------------------------------------------------
def loop(losses, patience):
    best, wait, best_at = float("inf"), 0, None
    for i, v in enumerate(losses, 1):
        if v < best:
            best, wait, best_at = v, 0, i
        else:
            wait += 1
            if wait >= patience:
                return i, True, best_at
    return len(losses), False, best_at


def test_early_stop_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    runs = {i: rng.random(rng.integers(3, 40)).round(2) for i in range(60)}
    runs[60] = np.array([5, 4, 3, 3, 3, 3, 1, 0.5])  # improves again after the limit
    d = spark.createDataFrame([(k, e, float(v)) for k, vs in runs.items() for e, v in enumerate(vs, 1)],
                              "run_id bigint, epoch bigint, val_loss double")
    stops = {r.run_id: (r.stop_epoch, r.stopped_early) for r in hi.early_stop(d, 3).collect()}
    best = {r.run_id: r.best_epoch for r in hi.best_epoch(d, 3).collect()}
    for k, vs in runs.items():
        stop, early, at = loop(vs, 3)
        assert stops[k] == (stop, early) and best[k] == at


def test_history_csv_roundtrip(spark, tmp_path):
    rows = [(1, "tl", e, m, 0.123456789012 * e) for e in (1, 2) for m in ("loss", "val_loss")]
    h = spark.createDataFrame(rows, "run_id bigint, phase string, epoch bigint, metric string, value double")
    runstore.save_history(h, str(tmp_path / "h"), ["loss", "val_loss"])
    back = runstore.load_history(spark, str(tmp_path / "h"), ["loss", "val_loss"])
    assert {(r.epoch, r.metric, r.value) for r in back.collect()} == {(e, m, round(v, 8)) for _, _, e, m, v in rows}


# stores -----------------------------------------------------------------------------------------
def test_split_modes(spark, arrays, tmp_path):
    split = pt.split_patches(arrays.select("patch_id").distinct())
    with pytest.raises(ValueError, match="copy"):
        patchstore.write_split(arrays, split, str(tmp_path / "s"), "move")
    patchstore.write_split(arrays, split, str(tmp_path / "c"), "copy")
    patchstore.write_split(arrays, split, str(tmp_path / "l"), "symlink")
    a = patchstore.read_split(spark, str(tmp_path / "c"))
    b = patchstore.read_split(spark, str(tmp_path / "l"), arrays)
    pick = lambda d: sorted((r.patch_id, r.channel, r.split) for r in d.select("patch_id", "channel", "split").collect())
    assert pick(a) == pick(b)


def test_missing_stats_warn(spark, tmp_path):
    with pytest.warns(UserWarning, match="no channel statistics"):
        assert patchstore.read_stats(spark, str(tmp_path / "none")) is None


def test_registry_appends(spark, tmp_path):
    row = lambda i: spark.createDataFrame([(f"run{i}", "n", {"ht": "1.3"}, "m", None)], runstore.REGISTRY_SCHEMA)
    runstore.register_run(row(1), str(tmp_path / "r"))
    runstore.register_run(row(2), str(tmp_path / "r"))
    assert runstore.read_registry(spark, str(tmp_path / "r")).count() == 2


def test_raster_band_read_prunes_partitions(spark, tmp_path):
    g = np.arange(30.0).reshape(5, 6)
    px = pixels_of(spark, {"r": g}, 1).union(pixels_of(spark, {"r": g * 2}, 2))
    meta = meta_of(spark, {"r": g.shape})
    rasters.write_raster(pixels_to_tiles(px, meta, 4), str(tmp_path / "t"), 4)
    back = rasters.read_raster(spark, str(tmp_path / "t"), [2])
    assert {(r.y, r.x, r.v) for r in back.select("y", "x", "v").collect()} == {(y, x, v * 2) for (y, x), v in np.ndenumerate(g)}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan or "PartitionFilters: [(band" in plan


def test_stored_side_places_cells(spark, tmp_path):
    g = np.arange(12.0).reshape(3, 4)
    px = pixels_of(spark, {"r": g})
    rasters.write_raster(pixels_to_tiles(px, meta_of(spark, {"r": g.shape}), 2), str(tmp_path / "t"), 2)
    assert np.array_equal(grid_of(rasters.read_raster(spark, str(tmp_path / "t")), g.shape), g)


def test_registry_keeps_text_ids(spark, tmp_path):
    row = spark.createDataFrame([("007", "n", {"ht": "1.3"}, "m", None)], runstore.REGISTRY_SCHEMA)
    runstore.register_run(row, str(tmp_path / "r"))
    assert runstore.read_registry(spark, str(tmp_path / "r")).first().run_id == "007"


def test_fill_keeps_bands_apart(spark):
    g = np.array([[1.0, 2.0], [3.0, 4.0]])
    px = pixels_of(spark, {"r": g}, 1).union(pixels_of(spark, {"r": g * 10}, 2))
    for bands in ((1, 2), (1,)):
        tiles = pixels_to_tiles(px, meta_of(spark, {"r": (2, 5)}), 2, fill=0.0, bands=bands).collect()
        assert {(t.band, t.tx): t.data for t in tiles if t.tx == 0} == {(1, 0): [1, 2, 3, 4], (2, 0): [10, 20, 30, 40]}
        assert sorted((t.band, t.tx) for t in tiles if t.tx) == [(b, x) for b in bands for x in (1, 2)]


def test_names(spark):
    d = spark.createDataFrame([("a/b.c/mask.tif",), ("mask.tar.gz",), ("noext",), (".hidden",)], "p string")
    got = [r.o for r in d.select(naming.with_suffix(F.col("p"), F.lit("_x")).alias("o")).collect()]
    assert got == ["a/b.c/mask_x.tif", "mask.tar_x.gz", "noext_x", ".hidden_x"]


@pytest.mark.parametrize("block", [1, 3, 8, 4096])
def test_early_stop_across_blocks(spark, block):
    """Against a loop over the epochs: ties, missing, NaN and infinite losses, gaps, runs without any loss."""
    rng = np.random.default_rng(block)
    rows, want = [], {}
    for run in range(25):
        epochs = sorted(rng.choice(60, rng.integers(1, 40), replace=False).tolist())
        best, wait, stop = float("inf"), 0, None
        for e in epochs:
            loss = [float(rng.integers(0, 30) - e // 4), None, float("nan"), float("inf")][rng.choice(4, p=[0.85, 0.05, 0.05, 0.05])]
            loss = None if run == 0 else loss
            rows.append((run, e, loss))
            if loss is not None and loss < best:
                best, wait = loss, 0
            else:
                wait += 1
            if wait >= 4 and stop is None:
                stop = e
        want[run] = (epochs[-1] if stop is None else stop, stop is not None)
    d = spark.createDataFrame(rows, "run_id bigint, epoch bigint, val_loss double")
    got = hi.early_stop(d, 4, block=block)
    assert {r.run_id: (r.stop_epoch, r.stopped_early) for r in got.collect()} == want
    assert hi.early_stop(d.limit(0), 4, block=block).count() == 0


def test_scoring_takes_patches_without_some_channels(spark):
    """A missing channel, image or height, is NaN for the model; NaN logits come back as NULL."""
    from rasterloom.catalog.patchsets import mean_minus_height
    from rasterloom.operators import scoring

    rows = [("p0", c, 2, [c / 8] * 4) for c in range(5)] + [("p1", 0, 2, [1.0] * 4)]
    rows += [("p2", c, 2, [1.0, None, 0.5, 0.0] if c == 3 else [1.0] * 4) for c in (1, 3, 4)] + [("p3", 2, 2, None)]
    table = spark.createDataFrame(rows, "patch_id string, channel int, size int, data array<double>")
    got = {r.patch_id: r.logits for r in scoring.score_patches(table, mean_minus_height).collect()}
    assert got == {"p0": [4 * (0.1875 - 0.5)] * 4, "p1": [None] * 4, "p2": [-2.0, -3.0, -2.5, -3.0]}
