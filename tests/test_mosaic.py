"""Several images on one grid against a cell-by-cell reading, and through the preprocessing plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import grid_of, meta_of, pixels_of
from rasterloom.model import META_SCHEMA, pixels_to_tiles, tiles_to_pixels
from rasterloom.operators.mosaic import mosaic_tiles
from rasterloom.plans.preprocess import PreprocessParams, preprocess
from rasterloom.sources.rasters import images_for
from test_vectors import SQUARE, crowns

SHAPE = (12, 13)


@pytest.mark.parametrize("fan,with_order", [(2, True), (16, True), (3, False)])
def test_first_valid_cell_wins(spark, fan, with_order):
    """More images than a task takes at once, holes, tied and missing priorities, images over the grid's edge."""
    rng = np.random.default_rng(4)
    grids, headers, want_order = {}, [], []
    for i in range(23):
        rid = f"i{i:02d}"
        g = rng.integers(1, 99, (6, 7)).astype(float) + i / 100
        g[rng.random(g.shape) < 0.4] = np.nan
        y, x = (int(v) for v in rng.integers(-4, 11, 2))
        priority = None if i % 5 == 0 else int(rng.integers(0, 4))
        grids[rid] = g
        headers.append((rid, 32736, 6, 7, 2, "float32", None, float(x), float(y), 1.0, 1.0, priority))
        want_order.append((priority is None, priority or 0, rid, y, x) if with_order else (False, 0, rid, y, x))
    want = np.full(SHAPE, np.nan)
    for *_, rid, y, x in sorted(want_order):
        for (r, c), v in np.ndenumerate(grids[rid]):
            if 0 <= y + r < SHAPE[0] and 0 <= x + c < SHAPE[1] and np.isnan(want[y + r, x + c]):
                want[y + r, x + c] = v
    metas = spark.createDataFrame(headers, META_SCHEMA + ", priority int")
    metas = metas if with_order else metas.drop("priority")
    images = metas.withColumn("grid_id", F.lit("ref"))
    px = pixels_of(spark, grids).unionByName(pixels_of(spark, {k: g * 2 for k, g in grids.items()}, band=2))
    packed = pixels_to_tiles(px, metas, 4)
    frame = meta_of(spark, {"ref": SHAPE})
    got = mosaic_tiles(packed, images, frame, 4, 5, fan=fan)
    for band in (1, 2):
        np.testing.assert_allclose(grid_of(tiles_to_pixels(got.filter(F.col("band") == band), 5), SHAPE, "ref"), want * band)
    few = spark.createDataFrame([("ref", 1, 1)], "raster_id string, ty int, tx int")
    part = mosaic_tiles(packed, images, frame, 4, 5, wanted=few, seen=True, fan=fan).collect()
    assert [(r.ty, r.tx) for r in part] == [(1, 1)] * 2 and {r.seen for r in part} == {int((~np.isnan(want[5:10, 5:10])).sum())}


def test_unknown_grids_and_no_images(spark):
    frame, g = meta_of(spark, {"ref": SHAPE}), np.ones((3, 3))
    lost = meta_of(spark, {"a": g.shape}).withColumn("grid_id", F.lit("elsewhere"))
    packed = pixels_to_tiles(pixels_of(spark, {"a": g}), lost, 4)
    assert mosaic_tiles(packed, lost, frame, 4, 4).count() == 0
    assert mosaic_tiles(packed.limit(0), lost.limit(0), frame, 4, 4).count() == 0
    with pytest.raises(ValueError):
        mosaic_tiles(packed, lost, frame, 4, 4, fan=1)


def test_preprocess_on_a_reference(spark):
    """An image cut in two overlapping flights gives what the whole image gives; other rasters are not taken."""
    rng = np.random.default_rng(8)
    shape, ref = (16, 16), "x_OM_ref.tif"
    whole = {b: rng.integers(1, 60000, shape).astype(float) for b in (1, 2)}
    top = {ref: rng.random(shape) * 20 + 100}
    px = None
    for b, g in whole.items():
        right, dsm_like = g[:, 6:].copy(), np.full(shape, 7.0)
        right[:, :2] += 5  # the reference comes first where both have a cell
        left = g.copy()
        left[:, 10:] = np.nan
        part = pixels_of(spark, {ref: left, "y_OM_right.tif": right, "a_DSM_.tif": dsm_like}, band=b)
        px = part if px is None else px.unionByName(part)
    meta = meta_of(spark, {ref: shape}).unionByName(meta_of(spark, {"y_OM_right.tif": (16, 10)}, x0=6.0)).unionByName(
        meta_of(spark, {"a_DSM_.tif": shape}))
    one = pixels_of(spark, {ref: whole[1]}, band=1).unionByName(pixels_of(spark, {ref: whole[2]}, band=2))
    params = PreprocessParams(target_gsd=1.0, sigma=1.0, bands=[2, 1], windows=[3], method="local_min", patch_size=4,
                              patch_nodata=1.0, patch_image_nodata=1.0)
    shapes, surface, frame = crowns(spark, [[SQUARE]]).withColumn("raster_id", F.lit(ref)), pixels_of(spark, top), meta_of(spark, {ref: shape})
    got = preprocess(shapes, px, meta, surface, frame, params, reference=ref)
    want = preprocess(shapes, one, frame, surface, frame, params)
    rows = lambda out: sorted(map(tuple, out.features.collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 0
    assert sorted(map(tuple, got.status.collect())) == sorted(map(tuple, want.status.collect()))
    assert images_for(meta, ref)[0].count() == 2
