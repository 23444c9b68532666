"""Scanline burning against the even-odd rule, polygon checks, resampling."""

import re

import numpy as np
import pytest

from helpers import grid_of, inside, meta_of, pixels_of
from rasterloom.model import pixels_to_tiles, tiles_to_pixels
from rasterloom.operators import rasterize as rz, resample

SCHEMA = "crown_id bigint, raster_id string, crown_category string, crs_epsg int, rings array<array<struct<x:double,y:double>>>"


def crowns(spark, shapes, category="son"):
    return spark.createDataFrame([(i, "r", category, 32736, rings) for i, rings in enumerate(shapes)], SCHEMA)


CONCAVE = [(1.2, 1.1), (10.3, 1.4), (10.1, 9.2), (6.0, 3.1), (1.7, 9.4), (1.2, 1.1)]
SQUARE = [(2.0, 2.0), (12.0, 2.0), (12.0, 12.0), (2.0, 12.0), (2.0, 2.0)]
HOLE = [(4.0, 4.0), (8.0, 4.0), (8.0, 9.0), (4.0, 9.0), (4.0, 4.0)]


def burned(spark, shapes, size=(14, 15), **kw):
    meta = meta_of(spark, {"r": size}, **kw)
    return grid_of(rz.burn(crowns(spark, shapes), meta), size, fill=0.0)


@pytest.mark.parametrize("rings", [[CONCAVE], [SQUARE, HOLE], [HOLE]])
def test_even_odd(spark, rings):
    want = np.array([[inside(rings, x + 0.5, y + 0.5) for x in range(15)] for y in range(14)], float)
    np.testing.assert_array_equal(burned(spark, [rings]), want)


def test_random_polygons(spark):
    rng = np.random.default_rng(5)
    shapes = []
    for _ in range(12):
        a = np.sort(rng.random(rng.integers(3, 9))) * 2 * np.pi
        r, c = rng.random(len(a)) * 6 + 0.5, rng.random(2) * 14
        ring = [(float(c[0] + q * np.cos(t)), float(c[1] + q * np.sin(t))) for q, t in zip(r, a)]
        shapes.append([ring + ring[:1]])
    want = np.array([[any(inside(s, x + 0.5, y + 0.5) for s in shapes) for x in range(15)] for y in range(14)], float)
    np.testing.assert_array_equal(burned(spark, shapes), want)


def test_painting_over_tile_edges(spark):
    """Many copies and overlapping polygons, runs longer than a tile and on its edges."""
    rng = np.random.default_rng(9)
    shapes = [[CONCAVE]] * 40 + [[SQUARE, HOLE]] * 3
    for _ in range(20):
        x, y, w, h = rng.integers(-3, 14, 2).tolist() + rng.integers(1, 12, 2).tolist()
        shapes.append([[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h)), (float(x), float(y))]])
    want = np.array([[any(inside(s, x + 0.5, y + 0.5) for s in shapes) for x in range(15)] for y in range(14)], float)
    meta = meta_of(spark, {"r": (14, 15)})
    for tile in (1, 4, 15, 64):
        painted = rz.burn_tiles(crowns(spark, shapes), meta, tile)
        np.testing.assert_array_equal(grid_of(tiles_to_pixels(painted, tile), (14, 15), fill=0.0), want)
        assert all(r["data"].count(1.0) for r in painted.select("data").collect())
    plan = rz.burn(crowns(spark, shapes), meta)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(raster_id" in line and "crown_id" not in line]
    assert exchanges and not [line for line in exchanges if re.search(r"\b[xy]#", line)]


def test_known_differing_crs_is_an_error(spark):
    meta = meta_of(spark, {"r": (6, 9)}).drop("crs_epsg")
    from pyspark.sql import functions as F
    table = crowns(spark, [[SQUARE]])
    assert rz.burn(table, meta.withColumn("crs_epsg", F.lit(32736))).count() > 0
    with pytest.raises(Exception, match="coordinate systems"):
        rz.burn(table, meta.withColumn("crs_epsg", F.lit(4326))).collect()


def test_shared_edge_covers_once_without_gap(spark):
    left = [(0.0, 0.0), (5.5, 0.0), (5.5, 6.0), (0.0, 6.0), (0.0, 0.0)]
    right = [(5.5, 0.0), (9.0, 0.0), (9.0, 6.0), (5.5, 6.0), (5.5, 0.0)]
    meta = meta_of(spark, {"r": (6, 9)})
    a, b = (rz.burn(crowns(spark, [[s]]), meta).count() for s in (left, right))
    assert a + b == 54 == rz.burn(crowns(spark, [[left], [right]]), meta).count()


def test_north_up_grid(spark):
    """Negative pixel height: row 0 is the northern edge."""
    square = [[(100.0, 50.0), (103.0, 50.0), (103.0, 48.0), (100.0, 48.0), (100.0, 50.0)]]
    got = burned(spark, [square], (5, 6), px=1.0, py=-1.0, x0=99.0, y0=51.0)
    want = np.zeros((5, 6))
    want[1:3, 1:4] = 1
    np.testing.assert_array_equal(got, want)


def test_filter_crowns(spark):
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    flat = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)]
    rows = [(0, "r", "son", 1, [SQUARE]), (1, "r", "soff", 1, [SQUARE, HOLE]), (2, "r", "other", 1, [SQUARE]),
            (3, "r", None, 1, [SQUARE]), (4, "r", "son", 1, None), (5, "r", "son", 1, [SQUARE[:-1]]),
            (6, "r", "son", 1, [flat]), (7, "r", "son", 1, [bow]), (8, "r", "son", 1, [])]
    got = rz.filter_crowns(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.crown_id for r in got.collect()) == [0, 1]


def test_concat_needs_one_crs(spark):
    a, b = crowns(spark, [[SQUARE]]), crowns(spark, [[HOLE]])
    assert rz.concat_crowns(a, a, b).count() == 3
    with pytest.raises(ValueError):
        rz.concat_crowns(a, b.withColumn("crs_epsg", b.crs_epsg + 1))


def resample_brute(g, h, w):
    out = np.full((h, w), np.nan)
    ky, kx = g.shape[0] / h, g.shape[1] / w
    for t in range(h):
        for u in range(w):
            cy, cx = (t + 0.5) * ky - 0.5, (u + 0.5) * kx - 0.5
            total = weight = 0.0
            for y in range(g.shape[0]):
                for x in range(g.shape[1]):
                    a = (1 - abs(y - cy) / max(ky, 1)) * (1 - abs(x - cx) / max(kx, 1))
                    if abs(y - cy) < max(ky, 1) and abs(x - cx) < max(kx, 1) and a > 1e-9 and not np.isnan(g[y, x]):
                        total, weight = total + a * g[y, x], weight + a
            if weight > 0:
                out[t, u] = total / weight
    return out


@pytest.mark.parametrize("gsd", [0.4, 1.0, 2.3])
def test_resample(spark, gsd):
    rng = np.random.default_rng(2)
    g = rng.random((9, 11))
    g[rng.random(g.shape) < 0.2] = np.nan
    meta = meta_of(spark, {"r": g.shape})
    target = rz.target_grid(meta, gsd)
    d = target.first()
    got = grid_of(resample.resample_bilinear(pixels_of(spark, {"r": g}), meta, target), (d.height, d.width))
    np.testing.assert_allclose(got, resample_brute(g, d.height, d.width), atol=1e-9)


def test_resample_outside_is_missing(spark):
    g = np.ones((4, 4))
    source = meta_of(spark, {"r": (4, 4)}, x0=2.0, y0=0.0)
    target = meta_of(spark, {"r": (4, 8)})
    got = grid_of(resample.resample_bilinear(pixels_of(spark, {"r": g}), source, target), (4, 8))
    assert np.isnan(got[:, :2]).all() and np.isnan(got[:, 6:]).all() and (got[:, 2:6] == 1).all()


SPIKE = [(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (12.0, 4.0), (8.0, 4.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
PINCHED = [(0.0, 0.0), (4.0, 4.0), (8.0, 0.0), (8.0, 8.0), (4.0, 4.0), (0.0, 8.0), (0.0, 0.0)]
ON_EDGE = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 0.0), (0.0, 8.0), (0.0, 0.0)]
BOW = [(0.0, 0.0), (8.0, 8.0), (8.0, 0.0), (0.0, 9.0), (0.0, 0.0)]
AWAY = [(20.0, 20.0), (22.0, 20.0), (22.0, 22.0), (20.0, 20.0)]
DOUBLED = [(0.0, 0.0), (8.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
CORNER_HOLE = [(2.0, 2.0), (5.0, 3.0), (4.0, 6.0), (2.0, 2.0)]


@pytest.mark.parametrize("rings,kept", [
    ([SQUARE], True), ([CONCAVE], True), ([SQUARE, HOLE], True), ([SQUARE, CORNER_HOLE], True), ([DOUBLED], True),
    ([SPIKE], False), ([PINCHED], False), ([ON_EDGE], False), ([BOW], False), ([SQUARE, AWAY], False), ([HOLE, SQUARE], False)])
def test_usable_shapes(spark, rings, kept):
    assert rz.filter_crowns(crowns(spark, [rings])).count() == kept


def test_placing_by_extent(spark):
    shapes = crowns(spark, [[SQUARE], [[(x + 30, y) for x, y in SQUARE]], [[(x + 14, y - 3) for x, y in SQUARE]]]).drop("raster_id")
    meta = meta_of(spark, {"a": (20, 20)}).union(meta_of(spark, {"b": (20, 20)}, x0=15.0)).union(meta_of(spark, {"c": (5, 5)}, x0=200.0, py=-1.0))
    got = {(r.crown_id, r.raster_id) for r in rz.place_crowns(shapes, meta, cell=7.0).collect()}
    assert got == {(0, "a"), (1, "b"), (2, "a"), (2, "b")}
    plan = rz.place_crowns(shapes, meta)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(Exception, match="coordinate systems"):
        rz.place_crowns(shapes.withColumn("crs_epsg", shapes.crs_epsg + 1), meta).collect()


def test_opposite_axes_resample(spark):
    g = np.arange(12.0).reshape(3, 4)
    src, dst = meta_of(spark, {"r": (3, 4)}), meta_of(spark, {"r": (3, 4)}, y0=3.0, py=-1.0)
    px = pixels_of(spark, {"r": g})
    np.testing.assert_allclose(grid_of(resample.resample_bilinear(px, src, dst), (3, 4)), g[::-1])
    tiles = resample.resample_tiles(pixels_to_tiles(px, src, 2), src, dst, 2, 2)
    np.testing.assert_allclose(grid_of(tiles_to_pixels(tiles, 2), (3, 4)), g[::-1])
