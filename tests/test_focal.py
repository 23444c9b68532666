"""Neighbourhood operators: kernels, tile form and pixel form against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import blur_brute, grid_of, meta_of, min_brute, pixels_of, slope_brute
from rasterloom.functions import kernels
from rasterloom.model import densify, pixels_to_tiles, tiles_to_pixels
from rasterloom.operators import focal, ground, tiles


def random_grid(shape, seed, missing=0.0):
    rng = np.random.default_rng(seed)
    g = rng.random(shape) * 10
    g[rng.random(shape) < missing] = np.nan
    return g


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 9), st.integers(1, 40), st.integers(0, 1000))
def test_sliding_min_kernel(h, w, size, seed):
    g = random_grid((h, w), seed, 0.2)
    lo, hi = size // 2, size - size // 2 - 1
    pad = np.pad(g, ((lo, hi), (0, 0)), constant_values=np.nan)
    got = kernels.sliding_min_rows(pad, size)
    for i in range(h):
        part = g[max(0, i - lo):i + hi + 1]
        want = np.where(np.isnan(part).all(axis=0), np.nan, np.nanmin(np.where(np.isnan(part), np.inf, part), axis=0))
        np.testing.assert_array_equal(got[i], want)


SHAPES = {"r": (23, 37), "s": (9, 9)}


@pytest.fixture(scope="module")
def grids():
    return {rid: random_grid(s, i, 0.15) for i, (rid, s) in enumerate(SHAPES.items())}


@pytest.fixture(scope="module")
def loaded(spark, grids):
    meta = meta_of(spark, SHAPES)
    px = pixels_of(spark, grids)
    return meta, px, pixels_to_tiles(px, meta, 8, float("nan")).cache()


def both(spark, df, size=8):
    px = tiles_to_pixels(df, size)
    return {rid: grid_of(px, s, rid) for rid, s in SHAPES.items()}


def test_tiles_roundtrip(spark, grids, loaded):
    for rid, g in both(spark, loaded[2]).items():
        np.testing.assert_array_equal(g, grids[rid])


@pytest.mark.parametrize("window", [1, 4, 5, 19, 60])
def test_min_filter_tiles(spark, grids, loaded, window):
    for rid, g in both(spark, tiles.min_filter(loaded[2], window, 8)).items():
        np.testing.assert_array_equal(g, min_brute(grids[rid], window))


@pytest.mark.parametrize("window", [1, 4, 7, 60])
def test_min_filter_pixels(spark, grids, loaded, window):
    meta, px, _ = loaded
    out = focal.min_filter(focal.with_dims(densify(px, meta), meta), window)
    for rid, s in SHAPES.items():
        np.testing.assert_array_equal(grid_of(out, s, rid), min_brute(grids[rid], window))


@pytest.mark.parametrize("sigma", [0.8, 3.0, 7.0])
def test_blur_both_forms(spark, grids, loaded, sigma):
    """Sigma 7 has a radius of 28: over three tile rings, and wider than the small raster."""
    meta, px, _ = loaded
    filled = px.fillna(0.0, ["v"])
    t = both(spark, tiles.gaussian_blur(pixels_to_tiles(filled, meta, 8, 0.0), sigma, 8))
    p = densify(focal.gaussian_blur(focal.with_dims(filled, meta), sigma), meta, 0.0)
    for rid, s in SHAPES.items():
        want = blur_brute(np.nan_to_num(grids[rid]), sigma)
        np.testing.assert_allclose(t[rid], want, atol=1e-9)
        np.testing.assert_allclose(grid_of(p, s, rid), want, atol=1e-9)


def test_slope_both_forms(spark, grids, loaded):
    meta, px, packed = loaded
    t = both(spark, tiles.gradient_magnitude(packed, 8))
    p = densify(focal.gradient_magnitude(focal.with_dims(px, meta)), meta, 0.0)
    for rid, s in SHAPES.items():
        np.testing.assert_allclose(t[rid], slope_brute(grids[rid]), atol=1e-9)
        np.testing.assert_allclose(grid_of(p, s, rid), slope_brute(grids[rid]), atol=1e-9)


@pytest.mark.parametrize("sigma", [0.8, 2.5])
def test_smooth_gradient_is_blur_of_gradient(spark, grids, loaded, sigma):
    out = both(spark, tiles.smooth_gradient(loaded[2], sigma, 8))
    for rid in SHAPES:
        np.testing.assert_allclose(out[rid], blur_brute(slope_brute(grids[rid]), sigma), atol=1e-9)


@pytest.mark.parametrize("windows", [[3, 6], [5, 40], [60]])
def test_local_min_surface_ways_agree(spark, grids, loaded, windows):
    """The square halo and the one-directional passes; which one is taken depends on sizes only."""
    ways = (tiles.local_min_surface(loaded[2], windows, 8), tiles._mean_of_passes(loaded[2], windows, 8))
    for rid in SHAPES:
        want = sum(min_brute(grids[rid], w) for w in windows) / len(windows)
        for df in ways:
            np.testing.assert_allclose(both(spark, df)[rid], want, atol=1e-12)


@pytest.mark.parametrize("tile", [8, None])
def test_local_min_ground(spark, grids, loaded, tile):
    meta, px, _ = loaded
    out = ground.from_local_min(densify(px, meta), meta, [3, 6], 2.0, tile)
    for rid, s in SHAPES.items():
        g = grids[rid]
        filled = np.where(np.isnan(g), np.nanmax(g), g)  # the definition: fill with the global maximum
        want = g - (min_brute(filled, 3) + min_brute(filled, 6)) / 2
        np.testing.assert_allclose(grid_of(out, s, rid, "ndsm"), want, atol=1e-12)
        conf = grid_of(out, s, rid, "conf")
        assert (conf[np.isnan(g)] == 0).all()


def test_absent_tiles_get_no_output(spark, loaded):
    meta, px, _ = loaded
    corner = px.filter("raster_id = 'r' and y < 8 and x < 8")
    out = tiles.min_filter(pixels_to_tiles(corner, meta, 8), 5, 8)
    assert [(r.ty, r.tx) for r in out.select("ty", "tx").collect()] == [(0, 0)]


def test_rejected_parameters(spark, loaded):
    meta, px, _ = loaded
    for bad in (dict(method="dtm"), dict(method="local_min", dtm=px), dict(method="guess")):
        with pytest.raises(ValueError):
            ground.detect(px, meta, **bad)


def test_small_tiles_share_one_block(spark):
    """One kernel call for 400 tiles of side 2, and batches of bounded size for a task's Python."""
    import pyarrow as pa

    from rasterloom.model import BATCH_BYTES, pixels_to_tiles, strip_batches

    g = np.arange(1600.0).reshape(40, 40)
    packed = pixels_to_tiles(pixels_of(spark, {"r": g}), meta_of(spark, {"r": g.shape}), 2)
    done = tiles.map_tiles(packed, lambda b: np.full(b.shape, float(b.size)), 2).collect()
    assert len(done) == 400 and {v for r in done for v in r.data} == {1600.0}
    schema = pa.schema([("k", pa.int32()), ("data", pa.list_(pa.float64()))])
    sizes = [b.num_rows for b in strip_batches((((k,), np.zeros(1 << 17)) for k in range(30)), schema)]
    assert sum(sizes) == 30 and max(sizes) * (1 << 20) <= BATCH_BYTES


def test_pixel_forms_are_dealt_by_the_size_of_the_grid(spark, monkeypatch):
    """Partitions grow with the cells, and blocks narrower than the raster give the brute-force numbers."""
    from rasterloom import model

    g = np.random.default_rng(3).normal(50, 9, (30, 23))
    meta, px = meta_of(spark, {"r": g.shape}), pixels_of(spark, {"r": g})
    monkeypatch.setattr(model, "PART_CELLS", 50)
    monkeypatch.setattr(focal, "LINE", 4)
    parts = model.cell_parts(meta)
    assert parts == 14 and densify(px, meta).rdd.getNumPartitions() == parts
    dims = focal.with_dims(densify(px, meta), meta)
    low = focal.local_min_surface(dims, [3, 6], parts=parts)
    soft = focal.gaussian_blur(dims, 1.0, parts=parts)
    assert low.rdd.getNumPartitions() == soft.rdd.getNumPartitions() == parts
    np.testing.assert_allclose(grid_of(low, g.shape), (min_brute(g, 3) + min_brute(g, 6)) / 2)
    np.testing.assert_allclose(grid_of(soft, g.shape), blur_brute(g, 1.0))
