"""Checks of the raster operators: sources, pointwise, neighbourhoods, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.catalog import sqlparts as s
from rasterloom.catalog.registry import check, r6, rounded
from rasterloom.catalog.sqlparts import sql
from rasterloom.functions import naming, pointwise as pw
from rasterloom.model import cell_parts, densify, pixels_to_tiles, tiles_to_pixels
from rasterloom.operators import focal, ground, mosaic, overlay as ov, resample, scoring, stats, tiles, tilestats
from rasterloom.operators.prefix import prefix_sum
from rasterloom.operators.rasterize import target_grid
from rasterloom.plans.preprocess import soften_with_ground
from rasterloom.runtime import work_folder
from rasterloom.sources import rasters, tables as t

TILE = 64
HT = 10.0  # height threshold used by the checks
BASE = (s.CELLS, s.META, s.GRID)


def _dsm(spark, sf):
    return densify(t.surface(spark, sf), t.meta(spark, sf))


def _dsm_tiles(spark, sf, fill=float("nan")):
    return pixels_to_tiles(t.surface(spark, sf).withColumn("band", F.lit(1)), t.meta(spark, sf), TILE, fill)


def _roots(spark, sf):
    """Square roots of the surface: irrational, so rounding for comparison meets no decimal ties."""
    return t.surface(spark, sf).withColumn("v", F.sqrt("v"))


def _dims(spark, sf, pixels):
    return focal.with_dims(pixels, t.meta(spark, sf))


def _cells_of(df, size=TILE):
    return tiles_to_pixels(df, size).select("raster_id", "y", "x", r6("v").alias("v"))


# sources ----------------------------------------------------------------------------------------
@check("src1_read_raster", sql(s.CELLS, s.IMAGE, body="select raster_id, band, y, x, v from image where band in (4, 5)"))
def _(spark, sf):
    path = work_folder(spark, "raster")
    rasters.write_raster(pixels_to_tiles(t.image(spark, sf), t.meta(spark, sf), TILE), path, TILE)
    return rasters.read_raster(spark, path, [4, 5]).filter("v is not null").select("raster_id", "band", "y", "x", "v")


@check("src2_raster_info", sql(s.HEADERS, body="""
select raster_id, 'EPSG:' || crs_epsg as crs, n_bands, height, width, dtype,
       round(least(x0, x0 + width * px), 6) as "left", round(least(y0, y0 + height * py), 6) as bottom,
       round(greatest(x0, x0 + width * px), 6) as "right", round(greatest(y0, y0 + height * py), 6) as top, nodata
from headers"""))
def _(spark, sf):
    return rounded(rasters.raster_info(t.headers(spark, sf)), "left", "bottom", "right", "top")


@check("src3_check_crs", sql(s.HEADERS, body="select raster_id, coalesce(crs_epsg = 4326, false) as crs_ok from headers"))
def _(spark, sf):
    return rasters.check_crs(t.headers(spark, sf), 4326).select("raster_id", "crs_ok")


@check("src5_select_images", sql(s.HEADERS, body="""
select raster_id, crs_epsg from headers where contains(raster_id, '_OM_') and raster_id like '%.tif'"""))
def _(spark, sf):
    return rasters.select_images(t.headers(spark, sf)).select("raster_id", "crs_epsg")


@check("snk1_write_raster", sql(*BASE, s.MASK, body="""
select raster_id, y, x, round(coalesce(mask, 255), 4) as v from grid left join mask using (raster_id, y, x)"""))
def _(spark, sf):
    path = work_folder(spark, "mask")
    known = t.soft_mask(spark, sf).withColumns({"band": F.lit(1), "v": F.nullif("mask", F.lit(255.0))})
    rasters.write_mask(pixels_to_tiles(known, t.meta(spark, sf), TILE, float("nan")), path, TILE)
    back = rasters.read_raster(spark, path)  # the sentinel stays a number here
    return back.select("raster_id", "y", "x", r6("v", 4).alias("v"))


@check("snk3_write_confidence", sql(*BASE, s.SURFACE, s.TERRAIN, body=f"""
select 'dtm' as method, raster_id, y, x, round({s.confidence('s.v - t.v', 1.3)}, 4) as conf
from surface s left join terrain t using (raster_id, y, x)"""))
def _(spark, sf):
    path = work_folder(spark, "confidence")
    found = ground.from_terrain(t.surface(spark, sf), t.terrain(spark, sf), 1.3).withColumn("method", F.lit("dtm"))
    rasters.write_confidence(found, t.meta(spark, sf), path, TILE)
    back = rasters.read_confidence(spark, path, ["dtm"]).filter("conf is not null")
    return back.select("method", "raster_id", "y", "x", r6("conf", 4).alias("conf"))


@check("snk4_write_ndsm_raw", sql(*BASE, s.SURFACE, s.TERRAIN, body="""
select raster_id, y, x, round(s.v - t.v, 4) as ndsm from surface s left join terrain t using (raster_id, y, x) where s.v - t.v is not null"""))
def _(spark, sf):
    path = work_folder(spark, "heights")
    rasters.write_heights(ground.from_terrain(t.surface(spark, sf), t.terrain(spark, sf), 1.3), t.meta(spark, sf), path, TILE)
    back = rasters.read_heights(spark, path).filter("ndsm is not null")
    return back.select("raster_id", "y", "x", r6("ndsm", 4).alias("ndsm"))


# pointwise --------------------------------------------------------------------------------------
@check("prj1_scale_to_unit", sql(s.CELLS, s.IMAGE, body="select raster_id, band, y, x, round(v / 65535, 6) as v from image"))
def _(spark, sf):
    return t.image(spark, sf).withColumn("v", r6(pw.scale_to_unit(F.col("v"))))


@check("prj2_minmax_normalise", sql(s.CELLS, s.IMAGE, body="""
select raster_id, band, y, x, round((v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8), 6) as v
from image window w as (partition by raster_id)"""))
def _(spark, sf):
    return rounded(stats.minmax_normalise(t.image(spark, sf)), "v")


@check("prj3_fill_missing", sql(*BASE, s.SURFACE, s.DSM, body="""
select raster_id, y, x, coalesce(v, 0) as v from dsm"""))
def _(spark, sf):
    return _dsm(spark, sf).select("raster_id", "y", "x", pw.fill_missing(F.col("v")).alias("v"))


@check("prj4_select_bands", sql(s.CELLS, s.IMAGE, body="""
select raster_id, cast(case band when 5 then 1 when 4 then 2 when 6 then 3 else 4 end as integer) as band, y, x, v
from image where band in (5, 4, 6, 7)"""))
def _(spark, sf):
    return ov.select_bands(t.image(spark, sf), [5, 4, 6, 7]).select("raster_id", "band", "y", "x", "v")


@check("prj5_stack_channels", sql(s.CELLS, s.IMAGE, s.SURFACE, body="""
select raster_id, cast(band - 1 as integer) as channel, y, x, v from image where band <= 4
union all select raster_id, 4, y, x, v from surface"""))
def _(spark, sf):
    img = ov.select_bands(t.image(spark, sf), [1, 2, 3, 4])
    return ov.stack_channels(img, t.surface(spark, sf), ["raster_id"])


@check("prj7_mark_nodata", sql(s.CELLS, s.MASK, body="""
select raster_id, y, x, case when (case when mask >= 0.5 and mask < 255 then 1 else 0 end) = 0 and mask < 0.25 then 255.0e0
       else mask end as mask from mask"""))
def _(spark, sf):
    m = F.col("mask")
    burned = F.when((m >= 0.5) & (m < 255), 1.0).otherwise(0.0)
    return t.soft_mask(spark, sf).withColumn("mask", pw.mark_nodata(burned, m, 0.25))


@check("prj8_height_confidence", sql(*BASE, s.SURFACE, s.DSM, body=f"""
select raster_id, y, x, round({s.confidence('v', HT)}, 6) as conf from dsm"""))
def _(spark, sf):
    return _dsm(spark, sf).select("raster_id", "y", "x", r6(pw.height_confidence(F.col("v"), HT)).alias("conf"))


@check("prj9_ground_from_dtm", sql(*BASE, s.SURFACE, s.TERRAIN, body=f"""
select raster_id, y, x, round(s.v - t.v, 6) as ndsm, coalesce(s.v - t.v < 1.3e0, false) as ground,
       round({s.confidence('s.v - t.v', 1.3)}, 6) as conf
from surface s left join terrain t using (raster_id, y, x)"""))
def _(spark, sf):
    return rounded(ground.from_terrain(t.surface(spark, sf), t.terrain(spark, sf), 1.3), "ndsm", "conf").drop("dsm")


def _two_ways(spark, sf):
    a = ground.from_terrain(t.surface(spark, sf), t.terrain(spark, sf), 1.3)
    b = ground.from_terrain(t.surface(spark, sf), t.terrain(spark, sf), 2.1)
    return a.select("raster_id", "y", "x", "ground", "conf"), b


for _mode, _fn, _op in (("or", "greatest", "or"), ("and", "least", "and")):
    @check(f"prj10_combine_{_mode}", sql(*BASE, s.SURFACE, s.TERRAIN, body=f"""
select raster_id, y, x, coalesce(s.v - t.v < 1.3e0, false) {_op} coalesce(s.v - t.v < 2.1e0, false) as ground,
       round({_fn}({s.confidence('s.v - t.v', 1.3)}, {s.confidence('s.v - t.v', 2.1)}), 6) as conf
from surface s left join terrain t using (raster_id, y, x)"""))
    def _(spark, sf, mode=_mode):
        return rounded(ground.combine(*_two_ways(spark, sf), mode), "conf")


_BLEND = f"""blended as (
  select m.raster_id, m.y, m.x, m.mask, {s.confidence('s.v - t.v', 1.3)} as conf,
         {s.blend('m.mask', s.confidence('s.v - t.v', 1.3), 0.6)} as final
  from mask m left join surface s using (raster_id, y, x) left join terrain t using (raster_id, y, x))"""


def _blended(spark, sf):
    found = ground.from_terrain(t.surface(spark, sf), t.terrain(spark, sf), 1.3)
    return soften_with_ground(t.soft_mask(spark, sf), found, 0.6)


@check("prj11_soft_blend", sql(s.CELLS, s.SURFACE, s.TERRAIN, s.MASK, _BLEND, body="""
select raster_id, y, x, mask, round(conf, 6) as conf, round(final, 6) as final from blended"""))
def _(spark, sf):
    return rounded(_blended(spark, sf), "conf", "final").select("raster_id", "y", "x", "mask", "conf", "final")


@check("prj12_normalise_ndsm", sql(*BASE, s.SURFACE, s.TERRAIN, s.DSM, """
h as (select d.raster_id, d.y, d.x, d.v as dsm, d.v - t.v as ndsm from dsm d left join terrain t using (raster_id, y, x)),
c as (select raster_id, least(coalesce(quantile_cont(ndsm, 0.95) filter (ndsm > 0), 2.8), 2.8) as c from h group by raster_id)""",
    body="""select raster_id, y, x, round(case when dsm is null then 0 else least(greatest(ndsm, 0), c) / c end, 6) as ndsm_norm
from h join c using (raster_id) where dsm is null or ndsm is not null
union all select raster_id, y, x, null from h where dsm is not null and ndsm is null"""))
def _(spark, sf):
    grid = ov.overlay(_dsm(spark, sf).withColumnRenamed("v", "dsm"), dtm=t.terrain(spark, sf))
    h = grid.withColumn("ndsm", F.col("dsm") - F.col("dtm")).drop("dtm")
    return ground.normalise_heights(h, 2.8).select("raster_id", "y", "x", r6("ndsm_norm").alias("ndsm_norm"))


@check("prj16_ground_confidence", sql(*BASE, s.SURFACE, s.TERRAIN, s.DSM, "src as (select raster_id, y, x, coalesce(v, 0) as v from dsm)",
    *s.slope("sl", "src"), *s.blurred("sm", "sl", 1.0, 4), """
top as (select raster_id, greatest(coalesce(quantile_cont(v, 0.95) filter (v > 0), max(v)), 1e-8) as c from sm group by raster_id)""",
    body=f"""select d.raster_id, d.y, d.x,
  coalesce(d.v - t.v < 1.3e0, false) and coalesce(d.v is not null and sm.v < 60, false) as ground,
  round(least({s.confidence('d.v - t.v', 1.3)}, case when d.v is null then 0 else 1 - least(greatest(sm.v / c, 0), 1) end), 6) as conf
from dsm d left join terrain t using (raster_id, y, x) join sm using (raster_id, y, x) join top using (raster_id)"""))
def _(spark, sf):
    found = ground.detect(t.surface(spark, sf), t.meta(spark, sf), "both", dtm=t.terrain(spark, sf), height_threshold=1.3,
                          sigma=1.0, slope_threshold=60.0, mode="and", tile=TILE)
    return found.select("raster_id", "y", "x", "ground", r6("conf").alias("conf"))


# joins ------------------------------------------------------------------------------------------
@check("join1_overlay", sql(s.CELLS, s.SURFACE, s.TERRAIN, s.MASK, body="""
select m.raster_id, m.y, m.x, m.mask, s.v as dsm, round(t.v, 6) as dtm
from mask m left join surface s using (raster_id, y, x) left join terrain t using (raster_id, y, x)"""))
def _(spark, sf):
    return rounded(ov.overlay(t.soft_mask(spark, sf), dsm=t.surface(spark, sf), dtm=t.terrain(spark, sf)), "dtm")


def _gather(src: str, gsd: float, reach_cells: int, band: str) -> list[str]:
    """Bilinear resampling in gather form: every target looks up its source neighbours."""
    axis = lambda n: (f"select raster_id, {n} as ns, round_even({n} * 1e0 / {gsd}, 0)::bigint as nt from meta")
    line = lambda name, n: f"""{name} as (
      select raster_id, t, j as s, 1 - abs(j - c) / greatest(k, 1) as w
      from (select raster_id, ns, t, c, k, cast(floor(c) as bigint) + o as j
            from (select *, (t + 0.5) * k - 0.5 as c from (
                    select raster_id, ns, ns * 1e0 / nt as k, unnest(range(nt)) as t from ({axis(n)}))),
                 (select unnest(range(-{reach_cells}, {reach_cells + 2})) as o))
      where j >= 0 and j < ns and 1 - abs(j - c) / greatest(k, 1) > 1e-9 and c >= -0.5 and c <= ns - 0.5)"""
    return [line("ly", "height"), line("lx", "width"), f"""moved as (
      select ly.raster_id, {band} as band, ly.t as y, lx.t as x, sum(ly.w * lx.w * q.v) / sum(ly.w * lx.w) as v
      from {src} q join ly on q.raster_id = ly.raster_id and q.y = ly.s
      join lx on q.raster_id = lx.raster_id and q.x = lx.s
      where q.v is not null group by ly.raster_id, {band}, ly.t, lx.t)"""]


_MOVED_SQL = (sql(s.CELLS, s.META, s.SURFACE, "root as (select raster_id, y, x, sqrt(v) as v from surface)", *_gather("root", 0.83, 1, "1"), body="""
select raster_id, y, x, round(v, 6) as v from moved"""))


@check("join5_resample_bilinear", _MOVED_SQL)
def _(spark, sf):
    m = t.meta(spark, sf)
    packed = pixels_to_tiles(_roots(spark, sf).withColumn("band", F.lit(1)), m, TILE)
    return _cells_of(resample.resample_tiles(packed, m, target_grid(m, 0.83), TILE, TILE)).filter("v is not null")


@check("join5_resample_bilinear_pixels", _MOVED_SQL)
def _(spark, sf):
    m = t.meta(spark, sf)
    out = resample.resample_bilinear(_roots(spark, sf).withColumn("band", F.lit(1)), m, target_grid(m, 0.83))
    return out.select("raster_id", "y", "x", r6("v").alias("v"))


_IMAGE_SQL = (sql(s.CELLS, s.META, s.IMAGE,
    "picked as (select raster_id, case band when 5 then 1 when 4 then 2 when 6 then 3 else 4 end as b, y, x, v from image where band in (4, 5, 6, 7))",
    *_gather("picked", 1.5, 3, "b"), """full_grid as (
  select raster_id, b::integer as band, y, unnest(range(w)) as x from (
    select raster_id, w, b, unnest(range(h)) as y from (
      select raster_id, round_even(height * 1e0 / 1.5, 0)::bigint as h, round_even(width * 1e0 / 1.5, 0)::bigint as w,
             unnest([1, 2, 3, 4]) as b from meta)))""",
    body="""select raster_id, band, y, x, round(coalesce(v / 65535, 0), 6) as v
from full_grid left join moved using (raster_id, band, y, x)"""))


@check("join6_resample_image", _IMAGE_SQL)
def _(spark, sf):
    m = t.meta(spark, sf)
    packed = pixels_to_tiles(t.image(spark, sf), m, TILE)
    out = resample.resample_image_tiles(packed, [5, 4, 6, 7], m, target_grid(m, 1.5), TILE, TILE)
    return tiles_to_pixels(out, TILE).select("raster_id", "band", "y", "x", r6("v").alias("v"))


@check("join6_resample_image_pixels", _IMAGE_SQL)
def _(spark, sf):
    m = t.meta(spark, sf)
    out = resample.resample_image(t.image(spark, sf), [5, 4, 6, 7], m, target_grid(m, 1.5))
    return out.select("raster_id", "band", "y", "x", r6("v").alias("v"))


# three overlapping flights; each is half a pixel or more off the reference, which comes last in the order
_FLIGHTS = {"A": (-20.5, 7.5, 2), "N": (30.5, -11.5, 1), "R": (0.0, 0.0, None)}
_REFERENCE = "scan_R_OM_field.tif"


def flights(spark, sf):
    """(image, headers) of overlapping orthomosaics named like files, with origins and an order."""
    named = lambda df: df.withColumn("raster_id", F.format_string("scan_%s_OM_field.tif", "raster_id"))
    at = lambda k: F.create_map(*[F.lit(x) for n, v in _FLIGHTS.items() for x in (n, v[k])])[F.col("raster_id")]
    headers = t.meta(spark, sf).withColumns({"x0": at(0), "y0": at(1), "priority": at(2)})
    return named(t.image(spark, sf)), named(headers)


_FLIGHT_VALUES = ", ".join(f"('{n}', {x}::double, {y}::double, {'null' if p is None else p})" for n, (x, y, p) in _FLIGHTS.items())


def _flight_axis(name: str, size: str, origin: str, reach: int) -> str:
    """Weights of every image's cells on the reference's target cells along one axis."""
    return f"""{name} as (
  select raster_id, t, j as s, 1 - abs(j - c) / greatest(k, 1) as w
  from (select *, cast(floor(c) as bigint) + o as j
        from (select raster_id, {size} as ns, t, k, (t + 0.5) * k - {origin} - 0.5 as c
              from meta join shift using (raster_id),
                   (select n * 1e0 / nt as k, unnest(range(nt)) as t
                    from (select {size} as n, round_even({size} * 1e0 / 1.5, 0)::bigint as nt from meta where raster_id = 'R'))),
             (select unnest(range(-{reach}, {reach + 2})) as o))
  where j >= 0 and j < ns and 1 - abs(j - c) / greatest(k, 1) > 1e-9 and c >= -0.5 and c <= ns - 0.5)"""


_MOSAIC = (
    f"shift as (select * from (values {_FLIGHT_VALUES}) as f(raster_id, x0, y0, priority))",
    "picked as (select raster_id, case band when 5 then 1 when 4 then 2 when 6 then 3 else 4 end as b, y, x, v from image where band in (4, 5, 6, 7))",
    _flight_axis("ly", "height", "y0", 3), _flight_axis("lx", "width", "x0", 3),
    """moved as (select raster_id, b as band, ly.t as y, lx.t as x, sum(ly.w * lx.w * q.v) / sum(ly.w * lx.w) as v
  from picked q join ly using (raster_id) join lx using (raster_id) where q.y = ly.s and q.x = lx.s group by 1, 2, 3, 4)""",
    """mosaic as (select band, y, x, arg_min(v, (coalesce(priority, 99), raster_id)) as v
  from moved join shift using (raster_id) group by band, y, x)""")


@check("src5_mosaic_on_reference", sql(s.CELLS, s.META, s.IMAGE, *_MOSAIC, """full_grid as (
  select b::integer as band, y, unnest(range(w)) as x from (
    select w, b, unnest(range(h)) as y from (
      select round_even(height * 1e0 / 1.5, 0)::bigint as h, round_even(width * 1e0 / 1.5, 0)::bigint as w,
             unnest([1, 2, 3, 4]) as b from meta where raster_id = 'R')))""",
    body=f"""select '{_REFERENCE}' as raster_id, g.band, g.y, g.x, round(coalesce(v / 65535, 0), 6) as v
from full_grid g left join mosaic using (band, y, x)"""))
def _(spark, sf):
    image, headers = flights(spark, sf)
    images, frame = rasters.images_for(headers, _REFERENCE)
    out = mosaic.mosaic_image_tiles(pixels_to_tiles(image, headers, TILE), [5, 4, 6, 7], images, target_grid(frame, 1.5), TILE, TILE)
    return tiles_to_pixels(out, TILE).select("raster_id", "band", "y", "x", r6("v").alias("v"))


@check("join8_halo_exchange", sql(*BASE, s.SURFACE, s.DSM, f"""
own as (select *, y // {TILE} as ty, x // {TILE} as tx from dsm join meta using (raster_id))""", body=f"""
select raster_id, cast(o.ty + dy as integer) as ty, cast(o.tx + dx as integer) as tx, count(*) as cells, count(v) as present,
       round(max(v), 6) as top
from own o, (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx)
where o.ty + dy >= 0 and (o.ty + dy) * {TILE} < height and o.tx + dx >= 0 and (o.tx + dx) * {TILE} < width
  and y >= (o.ty + dy) * {TILE} - 3 and y < (o.ty + dy + 1) * {TILE} + 3
  and x >= (o.tx + dx) * {TILE} - 3 and x < (o.tx + dx + 1) * {TILE} + 3
group by 1, 2, 3"""))
def _(spark, sf):
    strips = tiles.halo_exchange(_dsm_tiles(spark, sf), TILE, (3, 3), (3, 3))
    cells = strips.select("raster_id", "ty", "tx", F.explode("data").alias("v"))
    return cells.groupBy("raster_id", "ty", "tx").agg(
        F.count(F.lit(1)).alias("cells"), F.count("v").alias("present"), r6(F.max("v")).alias("top"))


# statistics -------------------------------------------------------------------------------------
def _layer_tiles(spark, sf, **layers):
    """Tiles with one array per pixel table; a tile that one of the tables lacks is left out."""
    pack = lambda name, px: pixels_to_tiles(px.withColumn("band", F.lit(1)), t.meta(spark, sf), TILE).select(
        "raster_id", "ty", "tx", F.col("data").alias(name))
    first, *rest = [pack(name, px) for name, px in layers.items()]
    for side in rest:
        first = first.join(side, ["raster_id", "ty", "tx"])
    return first


_COUNTS = sql(s.CELLS, s.MASK, body="""
select raster_id, count(*) filter (mask > 0 and mask < 255) as crown, count(*) filter (mask = 0) as zero,
       count(*) filter (mask = 255) as nodata from mask group by raster_id""")


@check("agg1_mask_counts", _COUNTS)
def _(spark, sf):
    return stats.mask_counts(t.soft_mask(spark, sf))


@check("agg1_mask_counts_tiles", _COUNTS)
def _(spark, sf):
    return tilestats.mask_counts(_layer_tiles(spark, sf, mask=t.soft_mask(spark, sf).withColumn("v", F.col("mask"))), column="mask")


_AUDIT = sql(s.CELLS, s.SURFACE, s.TERRAIN, s.MASK, _BLEND, body="""
select raster_id, count(*) filter (mask >= 0 and mask < 255 and conf > 0) as dampened,
       count(*) filter (mask = 255) - count(*) filter (final = 255) as resolved,
       count(*) filter (final > 0 and final < 255) as crown, count(*) filter (final = 0) as ground,
       count(*) filter (final = 255) as nodata
from blended group by raster_id""")


@check("agg2_blend_audit", _AUDIT)
def _(spark, sf):
    return stats.blend_audit(_blended(spark, sf))


@check("agg2_blend_audit_tiles", _AUDIT)
def _(spark, sf):
    b = _blended(spark, sf)
    return tilestats.blend_audit(_layer_tiles(spark, sf, **{n: b.withColumn("v", F.col(n)) for n in ("mask", "conf", "final")}))


_Q = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


_SUMMARY = sql(s.CELLS, s.SURFACE, body="select raster_id, min(v) as min, "
    + ", ".join(f"round(quantile_cont(v, {p}), 6) as {n}" for n, p in _Q.items()) + ", max(v) as max from surface group by raster_id")


@check("agg3_ndsm_summary", _SUMMARY)
def _(spark, sf):
    return rounded(stats.height_summary(t.surface(spark, sf)), *_Q)


@check("agg3_ndsm_summary_tiles", _SUMMARY)
def _(spark, sf):
    return rounded(tilestats.height_summary(_dsm_tiles(spark, sf)), *_Q)


_ROOT = "root as (select raster_id, y, x, sqrt(v) as v from surface)"
_HIST = _ROOT + """, h as (select raster_id, lo, hi, cast(least(floor((v - lo) / (hi - lo) * 64), 63) as integer) as bin, count(*) as n
  from root join (select raster_id, min(v) as lo, max(v) as hi from root group by raster_id) using (raster_id)
  group by 1, 2, 3, 4),
e as (select raster_id, lo, hi, unnest(range(64))::integer as bin from (select distinct raster_id, lo, hi from h))"""


_HISTOGRAM = sql(s.CELLS, s.SURFACE, _HIST, body="""
select raster_id, bin, round(lo + bin * ((hi - lo) / 64), 6) as "left", round(lo + (bin + 1) * ((hi - lo) / 64), 6) as "right",
       coalesce(n, 0) as n from e left join h using (raster_id, lo, hi, bin)""")


@check("agg4_histogram", _HISTOGRAM)
def _(spark, sf):
    return rounded(stats.histogram(_roots(spark, sf), bins=64), "left", "right")


@check("agg4_histogram_tiles", _HISTOGRAM)
def _(spark, sf):
    packed = pixels_to_tiles(_roots(spark, sf).withColumn("band", F.lit(1)), t.meta(spark, sf), TILE)
    return rounded(tilestats.histogram(packed, bins=64), "left", "right")


def _otsu(src: str, bins: int = 256) -> str:
    return f"""otsu_h as (select raster_id, lo, hi, cast(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) as bigint) as b, count(*) as n
  from {src} join (select raster_id, min(v) as lo, max(v) as hi from {src} group by raster_id) using (raster_id) group by 1, 2, 3, 4),
otsu_c as (select *, lo + (b + 0.5) * (hi - lo) / {bins} as m from otsu_h),
otsu_w as (select raster_id, b, m, sum(n) over u as c, sum(n) over a as t, sum(n * m) over u as cm, sum(n * m) over a as tm
  from otsu_c window u as (partition by raster_id order by b), a as (partition by raster_id)),
otsu_s as (select raster_id, b, m, c / t * (1 - c / t) * power(cm / c - (tm / t - c / t * (cm / c)) / greatest(1 - c / t, 1e-8), 2) as g from otsu_w),
otsu as (select raster_id, arg_max(m, (g, -b)) as threshold from otsu_s group by raster_id)"""


_OTSU = sql(s.CELLS, s.SURFACE, _otsu("surface"), body="select raster_id, round(threshold, 6) as threshold from otsu")


@check("agg5_otsu_threshold", _OTSU)
def _(spark, sf):
    return rounded(stats.otsu_threshold(t.surface(spark, sf)), "threshold")


@check("agg5_otsu_threshold_tiles", _OTSU)
def _(spark, sf):
    return rounded(tilestats.otsu_threshold(_dsm_tiles(spark, sf)), "threshold")


_P95 = sql(s.CELLS, s.SURFACE, body="""
select raster_id, round(quantile_cont(v, 0.95), 6) as p95 from surface where v > 0 group by raster_id""")


@check("agg6_p95_positive", _P95)
def _(spark, sf):
    return rounded(stats.upper_height(t.surface(spark, sf)), "p95")


@check("agg6_p95_positive_tiles", _P95)
def _(spark, sf):
    return rounded(tilestats.upper_height(_dsm_tiles(spark, sf)), "p95")


_VALLEY = f"""h as (select raster_id, least(floor((v - 1.0) / 69.0 * 300), 299)::bigint as b, count(*) as n
  from surface where v >= 1.0 and v <= 70.0 group by 1, 2),
e as (select raster_id, b, coalesce(n, 0) as n from (
  select raster_id, unnest(range(300)) as b from (select distinct raster_id from surface)) left join h using (raster_id, b)),
sm as (select e.raster_id, e.b, sum(f.n) as total from e cross join (select unnest(range(-5, 5)) as d) k
  join e f on f.raster_id = e.raster_id and f.b = {s.mirrored('e.b + k.d', '300')} group by 1, 2)"""


_VALLEY_SQL = sql(s.CELLS, s.SURFACE, _VALLEY, body="""
select raster_id, round(1.0 + (arg_min(b, (total, b)) + 0.5) * (69.0e0 / 300), 6) as valley from sm group by raster_id""")


@check("agg7_valley_threshold", _VALLEY_SQL)
def _(spark, sf):
    return rounded(stats.valley_threshold(t.surface(spark, sf), lo=1.0, hi=70.0), "valley")


@check("agg7_valley_threshold_tiles", _VALLEY_SQL)
def _(spark, sf):
    return rounded(tilestats.valley_threshold(_dsm_tiles(spark, sf), lo=1.0, hi=70.0), "valley")


@check("agg23_diag_table", sql(s.CELLS, s.SURFACE, _HIST.replace("64", "300").replace("63", "299"), body="""
select raster_id, bin, round(lo + bin * ((hi - lo) / 300), 6) as "left", round(lo + (bin + 1) * ((hi - lo) / 300), 6) as "right",
       coalesce(n, 0) as n, 10.0e0 as used, 12.5e0 as suggested from e left join h using (raster_id, lo, hi, bin)"""))
def _(spark, sf):
    return rounded(stats.diagnostic_table(_roots(spark, sf), 10.0, 12.5), "left", "right")


# neighbourhoods ---------------------------------------------------------------------------------
_ZERO = "src as (select raster_id, y, x, coalesce(v, 0) as v from dsm)"
_BLUR_SQL = sql(*BASE, s.SURFACE, s.DSM, _ZERO, *s.blurred("b", "src", 1.5, 6), body="select raster_id, y, x, round(v, 6) as v from b")


@check("win1_gaussian_blur", _BLUR_SQL)
def _(spark, sf):
    return _cells_of(tiles.gaussian_blur(_dsm_tiles(spark, sf, 0.0), 1.5, TILE))


@check("win1_gaussian_blur_pixels", _BLUR_SQL)
def _(spark, sf):
    soft = focal.gaussian_blur(_dims(spark, sf, t.surface(spark, sf)), 1.5, parts=cell_parts(t.meta(spark, sf)))
    return densify(soft, t.meta(spark, sf), 0.0).withColumn("v", r6("v"))


_MIN_SQL = sql(*BASE, s.SURFACE, s.DSM, *s.min_filtered("m", "dsm", 8), body="select raster_id, y, x, v from m")


@check("win2_min_filter", _MIN_SQL)
def _(spark, sf):
    return _cells_of(tiles.min_filter(_dsm_tiles(spark, sf), 8, TILE))


@check("win2_min_filter_pixels", _MIN_SQL)
def _(spark, sf):
    return focal.min_filter(_dims(spark, sf, _dsm(spark, sf)), 8, parts=cell_parts(t.meta(spark, sf))).select("raster_id", "y", "x", "v")


_LOW = (*s.min_filtered("m5", "dsm", 5), *s.min_filtered("m40", "dsm", 40))
_LOW_SQL = sql(*BASE, s.SURFACE, s.DSM, *_LOW, body="""
select raster_id, y, x, round((m5.v + m40.v) / 2, 6) as v from m5 join m40 using (raster_id, y, x)""")


@check("win3_local_min_surface", _LOW_SQL)
def _(spark, sf):
    return _cells_of(tiles.local_min_surface(_dsm_tiles(spark, sf), [5, 40], TILE))


@check("win3_local_min_surface_passes", _LOW_SQL)
def _(spark, sf):
    return _cells_of(tiles.local_min_surface(_dsm_tiles(spark, sf), [5, 40], TILE, passes=True))


@check("win3_local_min_surface_pixels", _LOW_SQL)
def _(spark, sf):
    low = focal.local_min_surface(_dims(spark, sf, _dsm(spark, sf)), [5, 40], parts=cell_parts(t.meta(spark, sf)))
    return low.select("raster_id", "y", "x", r6("v").alias("v"))


_SLOPE_SQL = sql(*BASE, s.SURFACE, s.DSM, _ZERO, *s.slope("g", "src"), body="select raster_id, y, x, round(v, 6) as v from g")


@check("win4_gradient_magnitude", _SLOPE_SQL)
def _(spark, sf):
    return _cells_of(tiles.gradient_magnitude(_dsm_tiles(spark, sf), TILE))


@check("win4_gradient_magnitude_pixels", _SLOPE_SQL)
def _(spark, sf):
    steep = focal.gradient_magnitude(_dims(spark, sf, t.surface(spark, sf)), parts=cell_parts(t.meta(spark, sf)))
    return densify(steep, t.meta(spark, sf), 0.0).withColumn("v", r6("v"))


@check("win5_uniform_smooth", sql(s.CELLS, s.SURFACE, _VALLEY, body="""
select raster_id, b::integer as bin, round(total / 10, 6) as smoothed from sm"""))
def _(spark, sf):
    h = stats.histogram_arrays(t.surface(spark, sf), bins=300, limits=(1.0, 70.0))
    smooth = stats.moving_mean(F.transform("counts", lambda c: c.cast("double")), 10)
    return h.select("raster_id", F.posexplode(smooth).alias("bin", "smoothed")).withColumn("smoothed", r6("smoothed"))


@check("win6_ground_local_min", sql(*BASE, s.SURFACE, s.DSM, *_LOW, f"""
h as (select raster_id, y, x, d.v - (m5.v + m40.v) / 2 as h from dsm d join m5 using (raster_id, y, x) join m40 using (raster_id, y, x))""",
    body=f"""select raster_id, y, x, round(h, 6) as ndsm, coalesce(h < {HT}, false) as ground,
       round({s.confidence('h', HT)}, 6) as conf from h"""))
def _(spark, sf):
    found = ground.from_local_min(t.surface(spark, sf), t.meta(spark, sf), [5, 40], HT, TILE)
    return rounded(found, "ndsm", "conf").drop("dsm")


@check("win7_ground_gradient", sql(*BASE, s.SURFACE, s.DSM, _ZERO, *s.slope("sl", "src"), *s.blurred("sm", "sl", 1.0, 4),
    _otsu("sm"), """top as (select raster_id, greatest(coalesce(quantile_cont(v, 0.95) filter (v > 0), max(v)), 1e-8) as c from sm group by raster_id)""",
    body="""select d.raster_id, d.y, d.x, round(sm.v, 6) as slope, round(threshold, 6) as threshold,
  d.v is not null and sm.v < threshold as ground,
  round(case when d.v is null then 0 else 1 - least(greatest(sm.v / c, 0), 1) end, 6) as conf
from dsm d join sm using (raster_id, y, x) join top using (raster_id) join otsu using (raster_id)""", once=True))
def _(spark, sf):
    found = ground.from_slope(t.surface(spark, sf), t.meta(spark, sf), 1.0, tile=TILE)
    return rounded(found, "slope", "threshold", "conf").drop("dsm")


@check("win8_cumulative_counts", sql(s.CELLS, s.SURFACE, body="""
select raster_id, v, n, cast(sum(n) over (partition by raster_id order by v) as bigint) as cum_n
from (select raster_id, v, count(*) as n from surface group by raster_id, v)"""))
def _(spark, sf):
    counts = t.surface(spark, sf).groupBy("raster_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return prefix_sum(counts, ["raster_id"], "v", ["n"]).drop("all_n")


@check("udf2_map_tiles", sql(*BASE, s.SURFACE, s.DSM, """
f as (select raster_id, y, x, max(v) over (partition by raster_id, x order by y rows between 2 preceding and 1 following) as v from dsm)""",
    body="select raster_id, y, x, v from f"))
def _(spark, sf):
    def highest(block):
        import numpy as np
        stack = np.stack([block[k:block.shape[0] - 3 + k] for k in range(4)])
        low = np.where(np.isnan(stack), -np.inf, stack).max(axis=0)
        return np.where(np.isinf(low), np.nan, low)

    return _cells_of(scoring.map_tiles(_dsm_tiles(spark, sf), highest, TILE, ry=(2, 1), edge=float("nan")))


# strings over headers ---------------------------------------------------------------------------
@check("str1_param_suffix", sql(s.HEADERS, body="""
select raster_id, regexp_replace('out/masks/' || raster_id, '(\\.[a-z]+)$', '_w5-40\\1') as path from headers"""))
def _(spark, sf):
    path = naming.with_suffix(F.concat(F.lit("out/masks/"), F.col("raster_id")), F.lit("_w5-40"))
    return t.headers(spark, sf).select("raster_id", path.alias("path"))
