"""Vector to raster: polygon checks, scanline burning, target grids and the soft mask."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions import kernels
from rasterloom.functions.pointwise import mark_nodata
from rasterloom.model import NODATA, TILE_SCHEMA, cell_parts, densify, fill_grid, tile_table, tiles_per_block, tiles_to_pixels
from rasterloom.operators import focal, tiles
from rasterloom.operators.overlay import CELL, overlay
from rasterloom.runtime import freeze, lookup_join

# The categories that become class 1.
INCLUDED = ("son", "soff")


def _edges(ring: Column) -> Column:
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.transform(steps, lambda i: F.struct(
        F.element_at(ring, i)["x"].alias("ax"), F.element_at(ring, i)["y"].alias("ay"),
        F.element_at(ring, i + 1)["x"].alias("bx"), F.element_at(ring, i + 1)["y"].alias("by")))


def _twice_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])


def well_formed(rings: Column) -> Column:
    """Closed rings of at least four points with some area."""
    def ring_ok(r):
        first, last = F.element_at(r, 1), F.element_at(r, -1)
        return F.when(F.size(r) < 4, False).otherwise(
            (first["x"] == last["x"]) & (first["y"] == last["y"]) & (F.abs(_twice_area(r)) > 0))

    ok = rings.isNotNull() & (F.size(rings) > 0) & F.forall(rings, ring_ok)
    return F.coalesce(ok, F.lit(False))


def _turn(a: tuple, b: tuple, c: tuple) -> Column:
    """Sign of the turn a -> b -> c: 0 on a line."""
    return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _between(p: tuple, a: tuple, b: tuple) -> Column:
    """Whether a point on the line through a and b lies between them, ends included."""
    along = lambda k: (p[k] >= F.least(a[k], b[k])) & (p[k] <= F.greatest(a[k], b[k]))
    return along(0) & along(1)


def _meeting(e: tuple, f: tuple) -> tuple[Column, Column, Column]:
    """How two edges meet: they cross in their insides, they touch somewhere, they share a stretch."""
    (a, b), (c, d) = e, f
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    crosses = (t1 * t2 < 0) & (t3 * t4 < 0)
    on = lambda t, p, x, y: (t == 0) & _between(p, x, y)
    touches = on(t1, c, a, b) | on(t2, d, a, b) | on(t3, a, c, d) | on(t4, b, c, d)
    longer = F.greatest(*[F.abs(F.least(F.greatest(a[k], b[k]), F.greatest(c[k], d[k])) - F.greatest(F.least(a[k], b[k]), F.least(c[k], d[k])))
                          for k in (0, 1)])
    shares = touches & (t1 == 0) & (t2 == 0) & (longer > 0)
    return crosses, touches, shares


def _shape() -> Column:
    """128 bits of the rings, by two hashes of different seeds: different outlines stay apart."""
    return F.struct(F.xxhash64("rings").alias("a"), F.xxhash64(F.lit("second"), "rings").alias("b"))


def _numbered_edges(crowns: DataFrame) -> DataFrame:
    """(shape, ring, i, n, a, b) for every edge with some length; shape tells the rings apart."""
    rings = crowns.select(_shape().alias("shape"), "rings").distinct()
    ring = rings.select("shape", F.posexplode("rings").alias("ring", "r"))
    moved = lambda r: F.filter(_edges(r), lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))
    edges = ring.select("shape", "ring", moved(F.col("r")).alias("edges")).select(
        "shape", "ring", F.size("edges").alias("n"), F.posexplode("edges").alias("i", "e"))
    return edges.select("shape", "ring", "i", "n", "e.*")


def broken_shapes(crowns: DataFrame) -> DataFrame:
    """(shape) of polygons whose rings cross, overlap, turn back on themselves or touch themselves, and
    of those with a hole that leaves its shell. Different rings may touch in points.

    Edges of a shape are dealt to bands of y, about as many as the shape has edges over eight, and
    compared inside a band, so neither a row nor a task holds all pairs of a large outline.
    """
    edges = freeze(_numbered_edges(crowns))
    box = edges.groupBy("shape").agg(F.min("ay").alias("low"), F.max("ay").alias("high"), F.ceil(F.count("*") / 8).alias("bands"))
    placed = edges.join(box, "shape")
    band = lambda y: F.least(F.floor((y - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bands")), F.col("bands") - 1)
    dealt = placed.withColumn("band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by"))))).drop("low", "high", "bands")
    e, f = dealt.alias("e"), dealt.alias("f")
    point = lambda t, k: (F.col(f"{t}.{k}x"), F.col(f"{t}.{k}y"))
    crosses, touches, shares = _meeting((point("e", "a"), point("e", "b")), (point("f", "a"), point("f", "b")))
    pairs = e.join(f, (F.col("e.shape") == F.col("f.shape")) & (F.col("e.band") == F.col("f.band")) & (
        (F.col("e.ring") < F.col("f.ring")) | ((F.col("e.ring") == F.col("f.ring")) & (F.col("e.i") < F.col("f.i")))))
    same = F.col("e.ring") == F.col("f.ring")
    step = F.col("f.i") - F.col("e.i")
    neighbours = same & ((step == 1) | (step == F.col("e.n") - 1))
    bad = pairs.filter(crosses | shares | (same & ~neighbours & touches)).select("e.shape")
    shell, hole = placed.filter("ring = 0").alias("e"), edges.filter("ring > 0").select(
        "shape", "ring", F.col("ax").alias("px"), F.col("ay").alias("py")).alias("h")
    over = (F.least("e.ay", "e.by") <= F.col("py")) & (F.col("py") < F.greatest("e.ay", "e.by"))
    at = F.col("e.ax") + (F.col("py") - F.col("e.ay")) / F.when(over, F.col("e.by") - F.col("e.ay")) * (F.col("e.bx") - F.col("e.ax"))
    corner = (F.col("px"), F.col("py"))
    edge_on = (_turn(point("e", "a"), point("e", "b"), corner) == 0) & _between(corner, point("e", "a"), point("e", "b"))
    outside = (
        hole.join(shell, F.col("h.shape") == F.col("e.shape")).groupBy(F.col("h.shape").alias("shape"), "h.ring", "px", "py")
        .agg(F.count_if(over & (at <= F.col("px"))).alias("left"), F.max(edge_on).alias("edge"))
        .filter("left % 2 = 0 and not edge").select("shape"))
    return bad.unionByName(outside).distinct()


def filter_crowns(crowns: DataFrame, categories: tuple[str, ...] = INCLUDED, crossings: bool = True) -> DataFrame:
    """Keep the listed categories (a NULL category is dropped) with a usable geometry."""
    usable = crowns.filter(F.col("crown_category").isin(*categories)).filter(well_formed(F.col("rings")))
    if not crossings:
        return usable
    return usable.join(freeze(broken_shapes(usable)), _shape() == F.col("shape"), "left_anti")


def concat_crowns(*tables: DataFrame) -> DataFrame:
    """Bag union of polygon tables. Differing coordinate systems are an error, not an assumption."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if both.select("crs_epsg").distinct().limit(2).count() > 1:
        raise ValueError("polygon tables use different coordinate systems")
    return both


def place_crowns(crowns: DataFrame, meta: DataFrame, cell: float = 256.0) -> DataFrame:
    """Give polygons the rasters whose extent their bounding box overlaps (one row per pair).

    Boxes and extents are dealt to squares of ``cell`` map units and meet on the square; a pair counts
    in the one square that holds the lower corner of the common part, so nothing has to be made
    distinct. Polygons in another coordinate system than the raster's are an error.
    """
    far = lambda o, n, p: F.col(o) + F.col(n) * F.col(p)
    ends = {"x0": far("x0", "width", "px"), "y0": far("y0", "height", "py")}
    extents = meta.select(
        "raster_id", F.col("crs_epsg").alias("_crs"), F.least("x0", ends["x0"]).alias("_l"), F.greatest("x0", ends["x0"]).alias("_r"),
        F.least("y0", ends["y0"]).alias("_b"), F.greatest("y0", ends["y0"]).alias("_t"))
    points = F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    boxes = crowns.select("*", F.array_min(xs).alias("_x0"), F.array_max(xs).alias("_x1"),
                          F.array_min(ys).alias("_y0"), F.array_max(ys).alias("_y1"))
    square = lambda v: F.floor(v / cell)
    deal = lambda df, l, r, b, t: df.withColumn("_cx", F.explode(F.sequence(square(F.col(l)), square(F.col(r))))).withColumn(
        "_cy", F.explode(F.sequence(square(F.col(b)), square(F.col(t)))))
    met = deal(boxes, "_x0", "_x1", "_y0", "_y1").join(deal(extents, "_l", "_r", "_b", "_t"), ["_cx", "_cy"])
    here = (F.col("_cx") == square(F.greatest("_x0", "_l"))) & (F.col("_cy") == square(F.greatest("_y0", "_b")))
    overlap = (F.col("_x0") < F.col("_r")) & (F.col("_x1") > F.col("_l")) & (F.col("_y0") < F.col("_t")) & (F.col("_y1") > F.col("_b"))
    differs = F.raise_error(F.lit("polygons and raster use different coordinate systems")).cast("string")
    known = F.when(F.col("crs_epsg").eqNullSafe(F.col("_crs")), F.col("raster_id")).otherwise(differs)
    return met.filter(here & overlap).select(*crowns.columns, known.alias("raster_id"))


def spans(crowns: DataFrame, meta: DataFrame) -> DataFrame:
    """(raster_id, rh, rw, y, _c0, _c1): the runs of cells of a row whose centres lie inside a polygon.

    Every edge is expanded to the pixel rows it crosses, and the crossings of one polygon and row are
    paired from left to right. The even-odd rule leaves holes open; half-open comparisons keep touching
    polygons free of gaps and doubles. Polygons without a ``raster_id`` are placed by their coordinates
    first. A polygon whose known coordinate system is not its raster's is an error.
    """
    if "raster_id" not in crowns.columns:
        crowns = place_crowns(crowns, meta)
    codes = "crs_epsg" in crowns.columns and "crs_epsg" in meta.columns
    dims = meta.select("raster_id", "height", "width", "x0", "y0", "px", "py", *([F.col("crs_epsg").alias("_crs")] if codes else []))
    placed = lookup_join(crowns.select("crown_id", "raster_id", "rings", *(["crs_epsg"] if codes else [])), dims, "raster_id", "inner")
    if codes:
        differs = F.raise_error(F.lit("polygons and raster use different coordinate systems")).cast("string")
        placed = placed.withColumn("raster_id", F.when(F.col("crs_epsg") != F.col("_crs"), differs).otherwise(F.col("raster_id")))
    edges = placed.select(
        "raster_id", "crown_id", "height", "width", "x0", "y0", "px", "py",
        F.explode(F.flatten(F.transform("rings", _edges))).alias("e"))
    u = lambda c: (F.col(f"e.{c}") - F.col("x0")) / F.col("px")
    v = lambda c: (F.col(f"e.{c}") - F.col("y0")) / F.col("py")
    flat = edges.select("raster_id", "crown_id", "height", "width",
                        u("ax").alias("ua"), v("ay").alias("va"), u("bx").alias("ub"), v("by").alias("vb"))
    low, high = F.least("va", "vb"), F.greatest("va", "vb")
    first = F.greatest(F.ceil(low - 0.5), F.lit(0))
    last = F.least(F.ceil(high - 0.5) - 1, F.col("height") - 1)
    lines = flat.withColumns({"_a": first, "_z": last}).filter("_a <= _z").withColumn(
        "y", F.explode(F.sequence("_a", "_z")))
    at = F.col("ua") + (F.col("y") + 0.5 - F.col("va")) / (F.col("vb") - F.col("va")) * (F.col("ub") - F.col("ua"))
    order = W.partitionBy("raster_id", "crown_id", "y").orderBy("u")
    return (
        lines.select("raster_id", "crown_id", "height", "width", "y", at.alias("u"))
        .withColumns({"_i": F.row_number().over(order), "_next": F.lead("u").over(order)})
        .filter("_i % 2 = 1 and _next is not null")
        .select("raster_id", F.col("height").cast("int").alias("rh"), F.col("width").cast("int").alias("rw"), F.col("y").cast("bigint").alias("y"),
                F.greatest(F.ceil(F.col("u") - 0.5), F.lit(0)).alias("_c0"),
                F.least(F.ceil(F.col("_next") - 0.5) - 1, F.col("width") - 1).alias("_c1"))
        .filter("_c0 <= _c1")
    )


def burn_tiles(crowns: DataFrame, meta: DataFrame, tile: int) -> DataFrame:
    """Tiles of 0 and 1 that hold a covered cell: 1 where the centre lies inside a polygon.

    Runs are cut at tile edges and become a rise at their first and a fall after their last cell. Rises
    and falls of one place are summed map-side, so a tile has at most ``tile * (tile + 1)`` rows however many
    polygons lie over it; a running sum along its rows paints it. Cells are never rows, and a group is a
    block of tiles.
    """
    tx = F.explode(F.expr(f"sequence(cast(_c0 div {tile} as int), cast(_c1 div {tile} as int))"))
    cut = spans(crowns, meta).select("raster_id", "rh", "rw", F.expr(f"cast(y div {tile} as int)").alias("ty"), tx.alias("tx"),
                                     F.expr(f"y % {tile} * {tile + 1}").alias("_line"), "_c0", "_c1")
    first = F.greatest(F.col("_c0") - F.col("tx") * tile, F.lit(0))
    after = F.least(F.col("_c1") - F.col("tx") * tile, F.lit(tile - 1)) + 1
    step = lambda at, d: F.struct((F.col("_line") + at).cast("int").alias("pos"), F.lit(d).alias("d"))
    key = ["raster_id", "ty", "tx", "rh", "rw"]
    ends = cut.select(*key, F.explode(F.array(step(first, 1), step(after, -1))).alias("e"))
    steps = ends.groupBy(*key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))

    n = tiles_per_block(tile)

    def paint(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rid, by, bx, rh, rw = (k.as_py() for k in key)
        slots, at = np.unique((table.column("ty").to_numpy() - by * n) * n + table.column("tx").to_numpy() - bx * n, return_inverse=True)
        m, ty, tx = len(slots), by * n + slots // n, bx * n + slots % n
        line = np.zeros((m, tile * (tile + 1)), np.int64)
        line[at, table.column("pos").to_numpy()] = table.column("d").to_numpy()
        covered = (np.cumsum(line.reshape(m, tile, tile + 1), axis=2) > 0).astype(np.float64)
        h, w = np.minimum(tile, rh - ty * tile), np.minimum(tile, rw - tx * tile)
        ids = dict(raster_id=[rid] * m, band=[1] * m, ty=ty, tx=tx, h=h, w=w, rh=[rh] * m, rw=[rw] * m)
        return tile_table(ids, [c[:a, :b].ravel() for c, a, b in zip(covered, h, w)])

    block = [F.expr(f"{c} div {n}").cast("int").alias(f"_b{c}") for c in ("ty", "tx")]
    return steps.groupBy("raster_id", *block, "rh", "rw").applyInArrow(paint, TILE_SCHEMA)


def burn(crowns: DataFrame, meta: DataFrame, tile: int = 256) -> DataFrame:
    """Covered cells, once each (``raster_id, y, x, v = 1``), unpacked from painted tiles."""
    painted = tiles_to_pixels(burn_tiles(crowns, meta, tile), tile)
    return painted.filter("v = 1").select("raster_id", "y", "x", "v")


def target_grid(meta: DataFrame, gsd: float) -> DataFrame:
    """The same bounds at another pixel size; heights and widths round half to even."""
    h = F.rint(F.col("height") * F.abs("py") / gsd).cast("bigint")
    w = F.rint(F.col("width") * F.abs("px") / gsd).cast("bigint")
    return meta.withColumns({
        "_h": h, "_w": w, "_px": F.col("px") * F.col("width") / w, "_py": F.col("py") * F.col("height") / h,
    }).withColumns({"height": F.col("_h"), "width": F.col("_w"), "px": F.col("_px"), "py": F.col("_py")}).drop(
        "_h", "_w", "_px", "_py")


def mask_tiles(crowns: DataFrame, meta: DataFrame, sigma: float, nodata_threshold: float, tile: int) -> DataFrame:
    """The soft mask as tiles: runs are painted into tiles, and one haloed kernel softens and marks."""
    weights, r = kernels.gaussian_weights(sigma), kernels.gaussian_radius(sigma)

    def soften(block: np.ndarray) -> np.ndarray:
        soft = kernels.blur_block(block, weights)
        inner = block[r:block.shape[0] - r, r:block.shape[1] - r]
        return np.where((inner == 0) & (soft < nodata_threshold), NODATA, soft)

    packed = fill_grid(burn_tiles(filter_crowns(crowns), meta, tile), meta, tile, 0.0)
    return tiles.map_tiles(packed, soften, tile, (r, r), (r, r))


def build_mask(crowns: DataFrame, meta: DataFrame, sigma: float, nodata_threshold: float,
               tile: int | None = 256) -> DataFrame:
    """Burn, soften, and mark what lies far from every polygon (``raster_id, y, x, mask``)."""
    if tile is None:
        burned = burn(filter_crowns(crowns), meta)
        base = densify(burned, meta, 0.0).select(*CELL, F.col("v").alias("burned"))
        soft = focal.gaussian_blur(focal.with_dims(burned, meta), sigma, parts=cell_parts(meta))
        grid = overlay(base, soft=soft).withColumn("soft", F.coalesce("soft", F.lit(0.0)))
    else:
        soft = mask_tiles(crowns, meta, sigma, nodata_threshold, tile)
        return tiles_to_pixels(soft, tile).select(*CELL, F.col("v").alias("mask"))
    return grid.select(*CELL, mark_nodata(F.col("burned"), F.col("soft"), nodata_threshold).alias("mask"))
