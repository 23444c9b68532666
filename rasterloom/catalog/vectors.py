"""Checks of polygons, target grids, the patch grid and the composed preprocessing plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.catalog import sqlparts as s
from rasterloom.catalog.rasters import BASE, HT, TILE, _LOW, _dsm, _gather
from rasterloom.catalog.registry import check, r6, rounded
from rasterloom.catalog.sqlparts import sql
from rasterloom.functions.pointwise import height_confidence, soft_blend
from rasterloom.model import cell_parts, densify, pixels_to_tiles, zip_tiles
from rasterloom.operators import focal, overlay as ov, patches as pt, rasterize as rz, stats, tiles, tilestats
from rasterloom.plans.preprocess import PreprocessParams, preprocess
from rasterloom.sources import tables as t

SIDE = 16


@check("src4_read_crowns", sql(s.CROWNS, body="""
select crown_id, raster_id, crown_category, 32736 as crs_epsg from crowns
union all select crown_id, raster_id, crown_category, 32736 from crowns where crown_category = 'son'"""))
def _(spark, sf):
    c = t.crowns(spark, sf)
    both = rz.concat_crowns(c, c.filter("crown_category = 'son'"))
    return both.select("crown_id", "raster_id", "crown_category", "crs_epsg")


@check("set1_concat_crowns", sql(s.CROWNS, body="""
select raster_id, crown_category, 2 * count(*) as n from crowns group by 1, 2"""))
def _(spark, sf):
    c = t.crowns(spark, sf)
    return rz.concat_crowns(c, c).groupBy("raster_id", "crown_category").agg(F.count(F.lit(1)).alias("n"))


@check("prj15_filter_crowns", sql(s.CROWNS, s.GOOD, body="select crown_id, raster_id, crown_category from good"))
def _(spark, sf):
    return rz.filter_crowns(t.crowns(spark, sf)).select("crown_id", "raster_id", "crown_category")


def _burned(spark, sf):
    return rz.burn(rz.filter_crowns(t.crowns(spark, sf)), t.meta(spark, sf))


@check("join4_rasterize", sql(*BASE, s.CROWNS, s.GOOD, s.BURNED, body="""
select g.raster_id, g.y, g.x, case when b.y is null then 0.0e0 else 1.0e0 end as v
from grid g left join burned b using (raster_id, y, x)"""))
def _(spark, sf):
    return densify(_burned(spark, sf), t.meta(spark, sf), 0.0)


_SHIFTED = """extents as (select raster_id, height, width, case raster_id when 'A' then 0 when 'N' then 48 else 90 end::double as x0 from meta)"""


@check("join4_place_by_extent", sql(*BASE, s.CROWNS, s.GOOD, _SHIFTED, body="""
select e.raster_id, g.y, g.x, count(*) as crowns from extents e join grid g using (raster_id)
join good c on abs(g.x + 0.5 + e.x0 - c.cx) + abs(g.y + 0.5 - c.cy) < c.r group by all"""))
def _(spark, sf):
    """Polygons that know no raster, over overlapping extents."""
    at = F.when(F.col("raster_id") == "A", 0.0).when(F.col("raster_id") == "N", 48.0).otherwise(90.0)
    shifted = t.meta(spark, sf).withColumn("x0", at)
    placed = rz.place_crowns(rz.filter_crowns(t.crowns(spark, sf).drop("raster_id")), shifted, cell=32.0)
    # one burn per polygon, to count how many cover a cell
    each = placed.withColumn("raster_id", F.concat_ws(":", "raster_id", "crown_id"))
    metas = shifted.join(placed.select("raster_id", "crown_id"), "raster_id").withColumn("raster_id", F.concat_ws(":", "raster_id", "crown_id"))
    cells = rz.burn(each, metas.drop("crown_id"))
    return cells.groupBy(F.substring_index("raster_id", ":", 1).alias("raster_id"), "y", "x").agg(F.count(F.lit(1)).alias("crowns"))


@check("set4_burn_once", sql(*BASE, s.CROWNS, s.GOOD, s.BURNED, body="""
select raster_id, y, count(*) as cells, count(distinct x) as distinct_cells from burned group by 1, 2"""))
def _(spark, sf):
    return _burned(spark, sf).groupBy("raster_id", "y").agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("x").alias("distinct_cells"))


@check("geo1_target_grid", sql(s.HEADERS, body="""
select raster_id, round_even(height * px / 0.05, 0)::bigint as height, round_even(width * px / 0.05, 0)::bigint as width,
       round(width * px / round_even(width * px / 0.05, 0), 9) as px, round(height * py / round_even(height * px / 0.05, 0), 9) as py
from headers"""))
def _(spark, sf):
    g = rz.target_grid(t.headers(spark, sf), 0.05)
    return g.select("raster_id", "height", "width", r6("px", 9).alias("px"), r6("py", 9).alias("py"))


_SOFT = (s.CROWNS, s.GOOD, s.BURNED, """
burn as (select g.raster_id, g.y, g.x, case when b.y is null then 0.0e0 else 1.0e0 end as v
  from grid g left join burned b using (raster_id, y, x))""", *s.blurred("soft", "burn", 1.5, 6))
_MASK_SQL = sql(*BASE, *_SOFT, body="""
select raster_id, y, x, round(case when b.v = 0 and s.v < 0.05 then 255 else s.v end, 6) as mask
from burn b join soft s using (raster_id, y, x)""")


@check("geo7_build_mask", _MASK_SQL)
def _(spark, sf):
    return rounded(rz.build_mask(t.crowns(spark, sf), t.meta(spark, sf), 1.5, 0.05, TILE), "mask")


@check("geo7_build_mask_pixels", _MASK_SQL)
def _(spark, sf):
    return rounded(rz.build_mask(t.crowns(spark, sf), t.meta(spark, sf), 1.5, 0.05, None), "mask")


# patch grid -------------------------------------------------------------------------------------
_NAME = """lpad(pr::varchar, length(n_rows::varchar)::integer, '0') || '_' || lpad(pc::varchar, length(n_cols::varchar)::integer, '0') || '_ms4'"""
_PGRID = f"""pgrid as (select raster_id, n_rows, n_cols, pr, unnest(range(n_cols)) as pc from (
  select raster_id, n_rows, n_cols, unnest(range(n_rows)) as pr from (
    select raster_id, (height + {SIDE - 1}) // {SIDE} as n_rows, (width + {SIDE - 1}) // {SIDE} as n_cols from meta)))"""


@check("geo2_tile_patches", sql(s.CELLS, s.META, s.SURFACE, body=f"""
select raster_id, y // {SIDE} as pr, x // {SIDE} as pc, count(*) as cells, max(v) as top,
       max(y % {SIDE})::integer as last_row from surface group by 1, 2, 3"""))
def _(spark, sf):
    return pt.place(t.surface(spark, sf), SIDE).groupBy("raster_id", "pr", "pc").agg(
        F.count(F.lit(1)).alias("cells"), F.max("v").alias("top"), F.max("iy").alias("last_row"))


@check("geo3_pad_patch", sql(s.CELLS, s.META, s.SURFACE, body=f"""
select raster_id || '/' || (y // {SIDE}) || '/' || (x // {SIDE}) as patch_id, {SIDE * SIDE} as cells,
       {SIDE * SIDE} - count(*) as zeros, round(max(v), 6) as top from surface group by 1"""))
def _(spark, sf):
    cut = pt.place(t.surface(spark, sf), SIDE).select(
        F.concat_ws("/", "raster_id", "pr", "pc").alias("patch_id"), F.lit(4).alias("channel"), "iy", "ix", "v")
    p = pt.pack_patches(cut, SIDE)
    zeros = F.size(F.filter("data", lambda v: v == 0)).cast("bigint")
    return p.select("patch_id", F.size("data").alias("cells"), zeros.alias("zeros"), r6(F.array_max("data")).alias("top"))


@check("geo2_tile_patches_stored", sql(s.CELLS, s.META, s.SURFACE, _PGRID, body=f"""
select p.raster_id || '/' || {_NAME} as patch_id, {SIDE * SIDE} as cells, round(coalesce(sum(v), 0), 6) as total
from pgrid p left join surface s on s.raster_id = p.raster_id and s.y // {SIDE} = p.pr and s.x // {SIDE} = p.pc group by 1"""))
def _(spark, sf):
    packed = pixels_to_tiles(t.surface(spark, sf).withColumn("band", F.lit(1)), t.meta(spark, sf), SIDE, fill=float("nan"))
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return pt.patches_from_tiles(packed, SIDE).select("patch_id", F.size("data").alias("cells"), r6(total).alias("total"))


@check("geo5_patch_transform", sql(s.CELLS, s.META, _PGRID, body=f"""
select raster_id, pr, pc, pc * {SIDE} * 1.0e0 as "left", pr * {SIDE} * 1.0e0 as top, 1.0e0 as px, 1.0e0 as py from pgrid"""))
def _(spark, sf):
    return pt.patch_grid(t.meta(spark, sf), SIDE).select("raster_id", "pr", "pc", "left", "top", "px", "py")


@check("geo6_patch_name", sql(s.CELLS, s.META, _PGRID, body=f"select raster_id, pr, pc, {_NAME} as name from pgrid"))
def _(spark, sf):
    return pt.patch_grid(t.meta(spark, sf), SIDE).select("raster_id", "pr", "pc", "name")


_FRAC = f"""frac as (
  select p.raster_id, p.pr, p.pc, coalesce(m.n, 0) / {SIDE * SIDE} as mask_nodata, ({SIDE * SIDE} - coalesce(i.n, 0)) / {SIDE * SIDE} as image_zero
  from pgrid p
  left join (select raster_id, y // {SIDE} as pr, x // {SIDE} as pc, count(*) as n from mask where mask = 255 group by 1, 2, 3) m using (raster_id, pr, pc)
  left join (select raster_id, y // {SIDE} as pr, x // {SIDE} as pc, count(*) as n
             from (select distinct raster_id, y, x from image where v <> 0) group by 1, 2, 3) i using (raster_id, pr, pc))"""


def _fractions(spark, sf):
    return pt.nodata_fractions(t.soft_mask(spark, sf), t.image(spark, sf), t.meta(spark, sf), SIDE)


def _tile_fractions(spark, sf):
    m = t.meta(spark, sf)
    mask = t.soft_mask(spark, sf).select("raster_id", F.lit(1).alias("band"), "y", "x", F.col("mask").alias("v"))
    return tilestats.nodata_fractions(pixels_to_tiles(mask, m, SIDE), pixels_to_tiles(t.image(spark, sf), m, SIDE), m, SIDE)


_FRAC_SQL = sql(s.CELLS, s.META, s.MASK, s.IMAGE, _PGRID, _FRAC, body="select * from frac")


@check("agg8_patch_nodata", _FRAC_SQL)
def _(spark, sf):
    return _fractions(spark, sf)


@check("agg8_patch_nodata_tiles", _FRAC_SQL)
def _(spark, sf):
    return _tile_fractions(spark, sf)


_QC_SQL = sql(s.CELLS, s.META, s.MASK, s.IMAGE, _PGRID, _FRAC, body="""
select raster_id, pr, pc, case when mask_nodata > 0.18 then 'skipped_mask' when image_zero > 0.36 then 'skipped_img' else 'kept' end as status
from frac""")


@check("geo4_qc_filter", _QC_SQL)
def _(spark, sf):
    return pt.qc_filter(_fractions(spark, sf), 0.18, 0.36).select("raster_id", "pr", "pc", "status")


@check("geo4_qc_filter_tiles", _QC_SQL)
def _(spark, sf):
    return pt.qc_filter(_tile_fractions(spark, sf), 0.18, 0.36).select("raster_id", "pr", "pc", "status")


# composed ---------------------------------------------------------------------------------------
FLAGSHIP_SQL = sql(*BASE, s.SURFACE, s.DSM, s.MASK, *s.min_filtered("m", "dsm", 7), f"""
final as (select d.raster_id, {s.blend('coalesce(k.mask, 255)', s.confidence('d.v - m.v', HT), 0.6)} as f
  from dsm d join m using (raster_id, y, x) left join mask k using (raster_id, y, x))""", body="""
select raster_id, count(*) filter (f > 0 and f < 255) as crown, count(*) filter (f = 0) as zero,
       count(*) filter (f = 255) as nodata from final group by raster_id""")


def _blend_counts(grid):
    conf = height_confidence(F.col("dsm") - F.col("low"), HT)
    return stats.mask_counts(grid.withColumn("mask", soft_blend(F.coalesce("mask", F.lit(255.0)), conf, 0.6)))


@check("ground_blend_counts", FLAGSHIP_SQL)
def ground_blend_counts(spark, sf):
    """Surface and mask tiles, minimum filter, confidence, blend, class counts.

    Layers meet per tile; the cells are never shuffled after packing.
    """
    side, meta = 128, t.meta(spark, sf)
    pack = lambda px: pixels_to_tiles(px.withColumn("band", F.lit(1)), meta, side, fill=float("nan"))
    dsm = pack(t.surface(spark, sf))
    mask = pack(t.soft_mask(spark, sf).withColumnRenamed("mask", "v"))
    return _blend_counts(zip_tiles(side, dsm=dsm, low=tiles.min_filter(dsm, 7, side), mask=mask))


@check("ground_blend_counts_pixels", FLAGSHIP_SQL)
def _(spark, sf):
    dsm = _dsm(spark, sf)
    parts = cell_parts(t.meta(spark, sf))
    low = focal.min_filter(focal.with_dims(dsm, t.meta(spark, sf)), 7, parts=parts).repartition(parts, "raster_id", "y")
    mask = t.soft_mask(spark, sf).withColumnRenamed("mask", "v").repartition(parts, "raster_id", "y")
    return _blend_counts(ov.overlay(dsm.withColumnRenamed("v", "dsm"), low=low, mask=mask))  # dealt like dsm, so not shuffled again


_PRE = PreprocessParams(target_gsd=1.0, sigma=1.5, nodata_threshold=0.05, windows=[5, 40], method="local_min",
                        height_threshold=HT, max_ndsm_height=50.0, patch_size=SIDE, patch_nodata=0.95,
                        patch_image_nodata=0.8)
_PRE_SQL = (*BASE, s.SURFACE, s.DSM, s.IMAGE, *_SOFT, *_LOW, f"""
mask0 as (select raster_id, y, x, case when b.v = 0 and s.v < 0.05 then 255 else s.v end as mask
  from burn b join soft s using (raster_id, y, x)),
h as (select d.raster_id, d.y, d.x, d.v as dsm, d.v - (m5.v + m40.v) / 2 as ndsm
  from dsm d join m5 using (raster_id, y, x) join m40 using (raster_id, y, x)),
mask as (select raster_id, y, x, {s.blend('k.mask', s.confidence('h.ndsm', HT), 0.6)} as mask
  from mask0 k join h using (raster_id, y, x)),
top as (select raster_id, least(coalesce(quantile_cont(ndsm, 0.95) filter (ndsm > 0), 50), 50) as c from h group by raster_id),
img as (select raster_id, y, x, case band when 5 then 0 when 4 then 1 when 6 then 2 else 3 end as channel, v / 65535 as v
  from image where band in (4, 5, 6, 7)),
img_seen as (select * from img where v <> 0)""", _PGRID,
    _FRAC.replace("from image where", "from img_seen where"), f"""
kept as (select *, raster_id || '/' || {_NAME} as patch_id from pgrid join frac using (raster_id, pr, pc)
  where not mask_nodata > 0.95 and not image_zero > 0.8),
ranked as (select patch_id, row_number() over (order by md5('42:' || patch_id), patch_id) as k, count(*) over () as n from kept),
split as (select patch_id, case when k <= floor(n * 0.7e0) then 'train' when k <= floor(n * 0.7e0) + floor(n * 0.2e0) then 'val' else 'test' end as split from ranked)""")


def _preprocessed(spark, sf):
    m = t.meta(spark, sf)
    return preprocess(t.crowns(spark, sf), t.image(spark, sf), m, t.surface(spark, sf), m, _PRE)


@check("preprocess_channel_stats", sql(*_PRE_SQL, """
px as (select channel, patch_id, v from img join kept k on k.raster_id = img.raster_id and k.pr = y // 16 and k.pc = x // 16
  union all select 4, patch_id, case when dsm is null then 0 else coalesce(least(greatest(ndsm, 0), c) / c, 0) end
  from h join top using (raster_id) join kept k on k.raster_id = h.raster_id and k.pr = y // 16 and k.pc = x // 16),
size as (select count(*) * 256 as n from split where split = 'train'),
sums as (select channel, sum(v) as a, sum(v * v) as b from px join split using (patch_id) where split = 'train' group by channel)""",
    body="""select channel::integer as channel, round(a / n, 6) as mean, round(sqrt(greatest(b / n - (a / n) * (a / n), 1e-12)), 6) as std
from sums, size"""))
def _(spark, sf):
    return rounded(_preprocessed(spark, sf).channel_stats, "mean", "std")


@check("preprocess_split", sql(*_PRE_SQL, body="select patch_id, split from split"))
def _(spark, sf):
    return _preprocessed(spark, sf).split


# the default detection on a grid of another pixel size --------------------------------------------
GSD = 1.25
_COARSE = dict(target_gsd=GSD, sigma=1.5, nodata_threshold=0.05, windows=[5, 40], method="both", gradient_sigma=1.0,
               height_threshold=HT, max_ndsm_height=50.0, patch_size=SIDE, patch_nodata=0.95, patch_image_nodata=0.8)


def _moved(name: str, src: str, band: str) -> str:
    return _gather(src, GSD, 2, band)[2].replace("moved as", f"{name} as")


def _coarse_sql(low: str, *low_tables: str) -> str:
    """The stages of preprocessing on the resampled grid; ``meta`` and ``grid`` name the target."""
    fine = s.META.replace("meta as", "meta0 as")
    axes = [x.replace("from meta)", "from meta0)") for x in _gather("surface", GSD, 2, "1")[:2]]
    burned = """burned as (select distinct g.raster_id, g.y, g.x from grid g join meta m using (raster_id) join good c
      on g.raster_id = c.raster_id and abs((g.x + 0.5e0) * kx - c.cx) + abs((g.y + 0.5e0) * ky - c.cy) < c.r)"""
    return sql(
        s.CELLS, fine, s.SURFACE, s.TERRAIN, s.IMAGE, *axes,
        "shots as (select raster_id, case band when 5 then 0 when 4 then 1 when 6 then 2 else 3 end as b, y, x, v from image where band in (4, 5, 6, 7))",
        _moved("moved_s", "surface", "1"), _moved("moved_t", "terrain", "1"), _moved("moved_i", "shots", "b"),
        f"""meta as (select raster_id, h as height, w as width, h0 * 1e0 / h as ky, w0 * 1e0 / w as kx from (
          select raster_id, height as h0, width as w0, round_even(height * 1e0 / {GSD}, 0)::bigint as h, round_even(width * 1e0 / {GSD}, 0)::bigint as w from meta0))""",
        s.GRID, s.CROWNS, s.GOOD, burned, *_SOFT[3:],
        "dsm as (select g.raster_id, g.y, g.x, m.v from grid g left join moved_s m using (raster_id, y, x))",
        *low_tables, "src as (select raster_id, y, x, coalesce(v, 0) as v from dsm)", *s.slope("sl", "src"), *s.blurred("sm", "sl", 1.0, 4),
        "scale as (select raster_id, greatest(coalesce(quantile_cont(v, 0.95) filter (v > 0), 0), 1e-8) as c from sm group by raster_id)",
        """mask0 as (select raster_id, y, x, case when b.v = 0 and s.v < 0.05 then 255 else s.v end as mask
          from burn b join soft s using (raster_id, y, x))""",
        f"h as (select d.raster_id, d.y, d.x, d.v as dsm, d.v - {low} as ndsm from dsm d {'join m5 using (raster_id, y, x) join m40 using (raster_id, y, x)' if low_tables else 'left join moved_t t using (raster_id, y, x)'})",
        f"""conf as (select h.raster_id, h.y, h.x, least({s.confidence('h.ndsm', HT)},
          case when h.dsm is null then 0 else 1 - least(greatest(sm.v / c, 0), 1) end) as conf from h join sm using (raster_id, y, x) join scale using (raster_id))""",
        f"mask as (select raster_id, y, x, {s.blend('k.mask', 'conf', 0.6)} as mask from mask0 k join conf using (raster_id, y, x))",
        "top as (select raster_id, least(coalesce(quantile_cont(ndsm, 0.95) filter (ndsm > 0), 50), 50) as c from h group by raster_id)",
        "img as (select raster_id, y, x, band as channel, v / 65535 as v from moved_i)", "img_seen as (select * from img where v <> 0)",
        _PGRID, _FRAC.replace("from image where", "from img_seen where"), f"""
kept as (select *, raster_id || '/' || {_NAME} as patch_id from pgrid join frac using (raster_id, pr, pc)
  where not mask_nodata > 0.95 and not image_zero > 0.8),
ranked as (select patch_id, row_number() over (order by md5('42:' || patch_id), patch_id) as k, count(*) over () as n from kept),
split as (select patch_id, case when k <= floor(n * 0.7e0) then 'train' when k <= floor(n * 0.7e0) + floor(n * 0.2e0) then 'val' else 'test' end as split from ranked),
px as (select channel, patch_id, v from img join kept k on k.raster_id = img.raster_id and k.pr = y // 16 and k.pc = x // 16
  union all select 4, patch_id, case when dsm is null then 0 else coalesce(least(greatest(ndsm, 0), c) / c, 0) end
  from h join top using (raster_id) join kept k on k.raster_id = h.raster_id and k.pr = y // 16 and k.pc = x // 16),
size as (select count(*) * 256 as n from split where split = 'train'),
sums as (select channel, sum(v) as a, sum(v * v) as b from px join split using (patch_id) where split = 'train' group by channel),
covered as (select split, count(*) as patches from split group by split)""",
        body="""select channel::integer as channel, round(a / n, 6) as mean, round(sqrt(greatest(b / n - (a / n) * (a / n), 1e-12)), 6) as std,
  (select patches from covered where split = 'train') as train_patches, (select count(*) from mask where mask = 255) as nodata_cells from sums, size""", once=True)


def _coarse(spark, sf, **terrain):
    m = t.meta(spark, sf)
    out = preprocess(t.crowns(spark, sf), t.image(spark, sf), m, t.surface(spark, sf), m, PreprocessParams(**_COARSE), **terrain)
    n = out.split.filter("split = 'train'").agg(F.count(F.lit(1)).alias("train_patches"))
    lost = out.tiles.agg(F.sum("n_nodata").cast("bigint").alias("nodata_cells"))
    totals = n.withColumn("k", F.lit(1)).join(lost.withColumn("k", F.lit(1)), "k")
    return rounded(out.channel_stats, "mean", "std").withColumn("k", F.lit(1)).join(totals, "k").drop("k")


@check("preprocess_both", _coarse_sql("(m5.v + m40.v) / 2", *_LOW))
def _(spark, sf):
    return _coarse(spark, sf)


@check("preprocess_both_terrain", _coarse_sql("t.v"))
def _(spark, sf):
    return _coarse(spark, sf, dtm=t.terrain(spark, sf), dtm_meta=t.meta(spark, sf))
