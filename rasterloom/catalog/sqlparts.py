"""Shared SQL: the table adapters as common table expressions, and a few expression builders."""

from __future__ import annotations

import re

CELLS = """cells as (
  select l_returnflag as raster_id, cast(floor(l_orderkey / 72) as bigint) as y,
         cast(l_partkey % 96 as bigint) as x, l_orderkey, l_suppkey, l_linenumber, l_quantity,
         l_extendedprice, l_linestatus
  from lineitem)"""
META = "meta as (select raster_id, max(y) + 1 as height, 96::bigint as width from cells group by raster_id)"
GRID = """grid as (
  select raster_id, y, unnest(range(width)) as x
  from (select raster_id, width, unnest(range(height)) as y from meta))"""
SURFACE = "surface as (select raster_id, y, x, min(l_extendedprice) / 1000 as v from cells group by raster_id, y, x)"
TERRAIN = """terrain as (
  select raster_id, y, x,
         min(l_extendedprice) / 1000 - max(case when l_linestatus = 'O' then l_quantity end) / 17 as v
  from cells group by raster_id, y, x)"""
MASK = """mask as (
  select raster_id, y, x, case when (count(*) + y + x) % 4 = 0 then 255.0e0
         else cast(sum(l_linenumber) % 10 as double) / 10 end as mask
  from cells group by raster_id, y, x)"""
IMAGE = """image as (
  select raster_id, cast(l_linenumber % 7 + 1 as integer) as band, y, x,
         cast(max((l_orderkey * 37 + l_suppkey * 101) % 65536) as double) as v
  from cells group by raster_id, 2, y, x)"""
DSM = "dsm as (select g.raster_id, g.y, g.x, s.v from grid g left join surface s using (raster_id, y, x))"
CROWNS = """crowns as (
  select s_suppkey as crown_id, case s_suppkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as raster_id,
         case s_nationkey % 4 when 0 then 'son' when 1 then 'soff' when 2 then 'other' end as crown_category,
         s_suppkey * 37 % 96 + 0.25e0 as cx, s_suppkey * 2 + 0.125e0 as cy,
         cast(s_nationkey % 4 + 2 as double) as r
  from supplier)"""
GOOD = """good as (
  select * from crowns where crown_category in ('son', 'soff')
  and crown_id % 11 <> 5 and crown_id % 13 <> 7 and crown_id % 17 <> 3)"""
BURNED = """burned as (
  select distinct g.raster_id, g.y, g.x from grid g join good c
  on g.raster_id = c.raster_id and abs(g.x + 0.5 - c.cx) + abs(g.y + 0.5 - c.cy) < c.r)"""
HEADERS = """headers as (
  select 'scan_' || p_partkey || case p_size % 3 when 0 then '_OM_shift.tif' when 1 then '_DSM_shift.tif'
           else '_OM_raw.png' end as raster_id,
         case p_size % 5 when 0 then 4326 when 1 then 32736 when 2 then 4326 when 3 then 32633 end as crs_epsg,
         cast(100 + p_size * 7 as bigint) as height, cast(200 + p_size * 13 as bigint) as width,
         7 as n_bands, 'uint16' as dtype, case when p_size % 2 = 0 then 255.0e0 end as nodata,
         p_partkey * 1.5e0 as x0, p_retailprice as y0, 0.03e0 * (1 + p_size % 3) as px,
         -(0.03e0 * (1 + p_size % 3)) as py
  from part)"""
PATCHES = """patches as (
  select printf('p%06d', vec_id // 5) as patch_id, cast(vec_id % 5 as integer) as channel,
         cast(unnest(range(64)) // 8 as bigint) as y, cast(unnest(range(64)) % 8 as bigint) as x,
         unnest(embedding)::double + 0.5 as v
  from embeddings)"""
PATCH_MASK = """pmask as (
  select patch_id, -1 as channel, y, x,
         case when v < 0.42 then 255.0e0 else least(round(v, 2), 1.0e0) end as v
  from patches where channel = 0)"""
PREDS = """preds as (
  select cast(floor(event_id / 5000) as bigint) as run_id,
         cast(floor(event_id % 5000 / 1000) as bigint) + 1 as epoch,
         case when event_id % 10 < 7 then 'train' when event_id % 10 < 9 then 'val' else 'test' end as split,
         cast(floor(event_id / 50) as bigint) as batch_id,
         round(ln(greatest(value, 0.01e0) / 50), 9) as logit,
         case when event_type = 'error' or cast(floor(event_id / 50) as bigint) % 20 = 7 then 255.0e0
              else cast(event_id * 7 % 11 as double) / 10 end as target
  from events)"""
PROBS = """probs as (select *, 1 / (1 + exp(-logit)) as p, target <> 255 as valid from preds)"""
HIST = """hist as (
  select cast(floor(event_id / 64) as bigint) as run_id, 'tl' as phase, event_id % 64 + 1 as epoch,
         value / 2 as loss, value as val_loss, cast(event_id * 7 % 11 as double) / 10 as f1,
         cast(event_id * 5 % 13 as double) / 13 as val_f1
  from events)"""
FILES = """files as (
  select 'patches/' || p_brand || '/' || p_partkey || '_ms4' || tail as path
  from (select p_brand, p_partkey, '.tif' as tail from part
        union all select p_brand, p_partkey, '_mask.tif' from part
          where p_partkey in (select l_partkey from lineitem where l_quantity >= 48)
        union all select p_brand, p_partkey, '_dsm.tif' from part
          where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity < 8)))"""


def sql(*ctes: str, body: str, once: bool = False) -> str:
    """A query over common tables; with ``once`` each is evaluated once however often it is read."""
    text = "with " + ",\n".join(ctes)
    return (re.sub(r"(^with |^)(\w+) as \(", r"\1\2 as materialized (", text, flags=re.M) if once else text) + "\n" + body


def mirrored(j: str, n: str) -> str:
    """A position reflected once at either end."""
    return f"(case when {j} < 0 then -1 - ({j}) when {j} >= {n} then 2 * {n} - 1 - ({j}) else {j} end)"


def taps(name: str, sigma: float, radius: int) -> str:
    g = f"exp(-0.5e0 * (d / {sigma}e0) * (d / {sigma}e0))"
    return (f"{name} as (select d, {g} / sum({g}) over () as w "
            f"from (select unnest(range(-{radius}, {radius + 1})) as d))")


def blurred(out: str, src: str, sigma: float, radius: int) -> list[str]:
    """Separable blur of the dense table ``src`` (raster_id, y, x, v) in gather form."""
    return [
        taps(f"{out}_t", sigma, radius),
        f"""{out}_y as (select g.raster_id, g.y, g.x, sum(t.w * s.v) as v
          from grid g join meta m using (raster_id) cross join {out}_t t
          join {src} s on s.raster_id = g.raster_id and s.x = g.x and s.y = {mirrored('g.y + t.d', 'm.height')}
          group by g.raster_id, g.y, g.x)""",
        f"""{out} as (select g.raster_id, g.y, g.x, sum(t.w * s.v) as v
          from grid g join meta m using (raster_id) cross join {out}_t t
          join {out}_y s on s.raster_id = g.raster_id and s.y = g.y and s.x = {mirrored('g.x + t.d', 'm.width')}
          group by g.raster_id, g.y, g.x)""",
    ]


def min_filtered(out: str, src: str, window: int) -> list[str]:
    lo, hi = window // 2, window - window // 2 - 1
    frame = f"rows between {lo} preceding and {hi} following"
    return [
        f"{out}_y as (select raster_id, y, x, min(v) over (partition by raster_id, x order by y {frame}) as v from {src})",
        f"{out} as (select raster_id, y, x, min(v) over (partition by raster_id, y order by x {frame}) as v from {out}_y)",
    ]


def slope(out: str, src: str) -> list[str]:
    """Sobel magnitude of the dense table ``src``, borders repeating the edge cell."""
    return [
        f"""{out}_a as (select raster_id, y, x, v,
          coalesce(lag(v) over c, v) as u, coalesce(lead(v) over c, v) as d
          from {src} window c as (partition by raster_id, x order by y))""",
        f"""{out}_b as (select raster_id, y, x, u + 2 * v + d as s, d - u as t from {out}_a)""",
        f"""{out} as (select raster_id, y, x,
          sqrt(power(coalesce(lead(s) over r, s) - coalesce(lag(s) over r, s), 2)
             + power(coalesce(lag(t) over r, t) + 2 * t + coalesce(lead(t) over r, t), 2)) as v
          from {out}_b window r as (partition by raster_id, y order by x))""",
    ]


def confidence(h: str, thr: float) -> str:
    t = f"least(greatest(({h} - {thr}e0) / {thr}e0, 0), 1)"
    return f"(case when {h} is null then 0 else 1 - (3 * {t} * {t} - 2 * {t} * {t} * {t}) end)"


def blend(mask: str, conf: str, thr: float) -> str:
    return (f"(case when {mask} >= 0 and {mask} < 255 then {mask} * (1 - {conf}) "
            f"when {mask} = 255 and {conf} > {thr} then 1 - {conf} else {mask} end)")


def draw(seed: int, epoch: int, op: str, channel: bool = False) -> str:
    tail = " || ':' || channel" if channel else ""
    return (f"(('0x' || substr(md5('{seed}:{epoch}:' || patch_id || ':{op}'{tail}), 1, 8))::bigint / 4294967296.0e0)")


def draw_between(lo: float, hi: float, seed: int, epoch: int, op: str, channel: bool = False) -> str:
    return f"({lo}e0 + {hi - lo!r}::double * {draw(seed, epoch, op, channel)})"
