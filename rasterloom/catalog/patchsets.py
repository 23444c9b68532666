"""Checks of patch tables: catalogue, splits, batches, statistics, augmentation, scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.catalog import sqlparts as s
from rasterloom.catalog.registry import check, r6, rounded
from rasterloom.catalog.scores import _AP, _BATCH, _CLS, _COMBINED, _CONF
from rasterloom.catalog.sqlparts import sql
from rasterloom.functions import naming
from rasterloom.operators import augment as aug, metrics as mt, overlay as ov, patches as pt, scoring, stats, tilestats
from rasterloom.plans.evaluation import evaluate_model
from rasterloom.plans.training_feed import training_feed
from rasterloom.runtime import work_folder
from rasterloom.sources import patchstore, tables as t

SEED, EPOCH = 7, 3
RANGES = aug.Ranges(hole_size=(2, 5))

_PARSED = """parsed as (
  select path, regexp_extract(path, '^(.*/)', 1) as folder, regexp_extract(path, '([^/]*)\\.tif$', 1) as file_stem from files),
kinds as (select *, case when contains(file_stem, '_mask') then 'mask' when contains(file_stem, '_dsm') then 'dsm' else 'image' end as kind,
  regexp_replace(file_stem, '(_mask|_dsm)$', '') as stem from parsed),
i as (select * from kinds where kind = 'image'), m as (select * from kinds where kind = 'mask'), d as (select * from kinds where kind = 'dsm')"""


@check("str4_parse_patch_name", sql(s.FILES, _PARSED, body="select path, folder, kind, stem from kinds"))
def _(spark, sf):
    p = F.col("path")
    return t.files(spark, sf).select(p, naming.folder(p).alias("folder"), naming.file_kind(p).alias("kind"),
                                     naming.triple_stem(p).alias("stem"))


@check("join2_find_triples", sql(s.FILES, _PARSED, body="""
select i.folder, i.stem, i.path as image, m.path as mask, d.path as dsm
from i join m using (folder, stem) join d using (folder, stem)"""))
def _(spark, sf):
    return ov.find_triples(t.files(spark, sf))


@check("join3_unmatched", sql(s.FILES, _PARSED, body="""
select i.folder, i.stem, i.path as image, case when m.path is null then 'no mask' else 'no dsm' end as reason
from i left join m using (folder, stem) left join d using (folder, stem) where m.path is null or d.path is null"""))
def _(spark, sf):
    return ov.unmatched(t.files(spark, sf))


@check("set3_missing_partner", sql(s.FILES, _PARSED, body="""
select reason, count(*) as n from (
  select case when m.path is null then 'no mask' else 'no dsm' end as reason
  from i left join m using (folder, stem) left join d using (folder, stem) where m.path is null or d.path is null) group by 1"""))
def _(spark, sf):
    return ov.unmatched(t.files(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# statistics and normalisation -------------------------------------------------------------------
_STATS = """st as (select channel, avg(v) as mean, greatest(stddev_pop(v), 1e-6) as std from patches group by channel)"""


def _pixels(spark, sf):
    return pt.unpack_patches(t.patches(spark, sf))


_STATS_SQL = sql(s.PATCHES, _STATS, body="select channel, round(mean, 6) as mean, round(std, 6) as std from st")


@check("agg21_channel_stats", _STATS_SQL)
def _(spark, sf):
    return rounded(stats.channel_stats(_pixels(spark, sf)), "mean", "std")


@check("agg21_channel_stats_tiles", _STATS_SQL)
def _(spark, sf):
    return rounded(tilestats.channel_stats(t.patches(spark, sf)), "mean", "std")


_Z = sql(s.PATCHES, _STATS, body="""
select patch_id, channel, y, x, round((v - mean) / std, 6) as v from patches join st using (channel)""")


@check("prj6_zscore", _Z)
def _(spark, sf):
    px = _pixels(spark, sf)
    return ov.zscore(px, stats.channel_stats(px)).select("patch_id", "channel", "y", "x", r6("v").alias("v"))


@check("snk6_stats_roundtrip", sql(s.PATCHES, _STATS, body="select channel, round(mean, 6) as mean, round(std, 6) as std from st"))
def _(spark, sf):
    path = work_folder(spark, "stats")
    patchstore.write_stats(stats.channel_stats(_pixels(spark, sf)), path)
    return rounded(patchstore.read_stats(spark, path), "mean", "std")


@check("join9_apply_stats", sql(s.PATCHES, _STATS, body="""
select channel, count(*) as n, round(avg((v - mean) / std), 6) + 0.0 as mean, round(stddev_pop((v - mean) / std), 6) as std
from patches join st using (channel) group by channel"""))
def _(spark, sf):
    px = _pixels(spark, sf)
    z = ov.zscore(px, stats.channel_stats(px))
    return rounded(z.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")),
                   "mean", "std")


# split, batches, stores -------------------------------------------------------------------------
_SPLIT = """ids as (select distinct patch_id from patches),
ranked as (select patch_id, row_number() over (order by md5('42:' || patch_id), patch_id) as rank, count(*) over () as n from ids),
split as (select patch_id, rank, case when rank <= floor(n * 0.7e0) then 'train'
  when rank <= floor(n * 0.7e0) + floor(n * 0.2e0) then 'val' else 'test' end as split from ranked)"""


def _split(spark, sf):
    return pt.split_patches(t.patches(spark, sf).filter("channel = 0").select("patch_id"), 0.7, 0.2, 42)


@check("ord1_split_patches", sql(s.PATCHES, _SPLIT, body="select patch_id, rank, split from split"))
def _(spark, sf):
    return _split(spark, sf)


@check("ord2_deterministic_order", sql(s.PATCHES, _SPLIT, body="""
select split, count(*) as n, min(patch_id) as first_id, max(patch_id) as last_id from split group by split"""))
def _(spark, sf):
    ids = t.patches(spark, sf).filter("channel = 0").select("patch_id").orderBy(F.col("patch_id").desc())
    return pt.split_patches(ids, 0.7, 0.2, 42).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("patch_id").alias("first_id"), F.max("patch_id").alias("last_id"))


@check("ord3_sample_patches", sql(s.PATCHES, _SPLIT, body="select patch_id, split from split where split = 'val' order by patch_id limit 6"))
def _(spark, sf):
    return pt.sample_patches(_split(spark, sf).select("patch_id", "split"), 6, "val")


@check("ord4_make_batches", sql(s.PATCHES, _SPLIT, body=f"""
select patch_id, split, cast(floor((row_number() over (partition by split order by
    case when split = 'train' then md5('{SEED}:{EPOCH}:' || patch_id) else '' end, patch_id) - 1) / 8) as bigint) as batch_id
from split"""))
def _(spark, sf):
    return pt.make_batches(_split(spark, sf).select("patch_id", "split"), 8, EPOCH, SEED).select("patch_id", "split", "batch_id")


@check("snk2_write_patches", sql(s.PATCHES, s.PATCH_MASK, body="""
select patch_id, channel, case channel when -1 then 'mask' when 4 then 'dsm' else 'image' end as kind, count(*)::integer as cells,
       round(max(v), 6) as top from (select * from patches union all select patch_id, channel, y, x, v from pmask)
group by 1, 2, 3"""))
def _(spark, sf):
    path = work_folder(spark, "patches")
    patchstore.write_patches(t.patches(spark, sf).unionByName(t.patch_masks(spark, sf)), path)
    return patchstore.read_patches(spark, path).select(
        "patch_id", "channel", "kind", F.size("data").alias("cells"), r6(F.array_max("data")).alias("top"))


for _mode in ("copy", "symlink"):
    @check(f"snk5_write_split_{_mode}", sql(s.PATCHES, _SPLIT, body="""
select split, patch_id, channel, round(max(v), 6) as top from patches join split using (patch_id) group by 1, 2, 3"""))
    def _(spark, sf, mode=_mode):
        path = work_folder(spark, f"split-{mode}")
        p = t.patches(spark, sf)
        patchstore.write_split(p, _split(spark, sf), path, mode)
        back = patchstore.read_split(spark, path, p if mode == "symlink" else None)
        return back.select("split", "patch_id", "channel", r6(F.array_max("data")).alias("top"))


# augmentation -----------------------------------------------------------------------------------
def _u(op, channel=False):
    return s.draw(SEED, EPOCH, op, channel)


def _b(lo, hi, op, channel=False):
    return s.draw_between(lo, hi, SEED, EPOCH, op, channel)


_ALL = "alls as (select patch_id, channel, y, x, v from patches union all select patch_id, channel, y, x, v from pmask)"
_IMG = "channel <> -1"


def _drawn(spark, sf):
    both = t.patches(spark, sf).unionByName(t.patch_masks(spark, sf))
    return pt.unpack_patches(aug.with_draws(both, EPOCH, SEED, RANGES))


def _out(px):
    return px.select("patch_id", "channel", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"),
                     r6("v").alias("v"))


@check("aug1_flip", sql(s.PATCHES, s.PATCH_MASK, _ALL, body=f"""
select patch_id, channel, case when {_u('flip_v')} < 0.5 then 7 - y else y end as y,
       case when {_u('flip_h')} < 0.5 then 7 - x else x end as x, round(v, 6) as v from alls"""))
def _(spark, sf):
    return _out(aug.flip(_drawn(spark, sf)))


@check("aug2_turn_transpose", sql(s.PATCHES, s.PATCH_MASK, _ALL, f"""
k as (select *, case when {_u('rotate')} < 0.5 then floor({_b(0, 4, 'turns')}) else 0 end as k, {_u('transpose')} < 0.5 as tr from alls),
r as (select patch_id, channel, tr, v, case k when 0 then y when 1 then 7 - x when 2 then 7 - y else x end as ry,
  case k when 0 then x when 1 then y when 2 then 7 - x else 7 - y end as rx from k)""",
    body="""select patch_id, channel, case when tr then rx else ry end as y, case when tr then ry else rx end as x, round(v, 6) as v from r"""))
def _(spark, sf):
    return _out(aug.turn(_drawn(spark, sf)))


def _radio(op, prob, new):
    return sql(s.PATCHES, s.PATCH_MASK, _ALL, body=f"""
select patch_id, channel, y, x, round(case when {_IMG} and {_u(op)} < {prob} then {new} else v end, 6) + 0.0 as v from alls""")


@check("aug4_tone", _radio("tone", 0.4, f"least(greatest(v * (1 + {_b(-0.15, 0.15, 'contrast')}) + {_b(-0.15, 0.15, 'brightness')}, 0), 1)"))
def _(spark, sf):
    return _out(aug.tone(_drawn(spark, sf)))


@check("aug5_gamma", _radio("gamma", 0.3, f"power(greatest(v, 0), {_b(0.85, 1.15, 'gamma_value')})"))
def _(spark, sf):
    return _out(aug.gamma(_drawn(spark, sf)))


@check("aug6_gain", _radio("gain", 0.3, f"v * {_b(0.92, 1.08, 'gain_value', True)}"))
def _(spark, sf):
    return _out(aug.gain(_drawn(spark, sf)))


def _lehmer(x, times):
    for _ in range(times):
        x = f"(({x}) * 48271 % 2147483647)"
    return x


@check("aug7_noise", sql(s.PATCHES, s.PATCH_MASK, _ALL, f"""
k as (select *, ('0x' || substr(md5('{SEED}:{EPOCH}:' || patch_id || ':noise_key:' || channel), 1, 8))::bigint % 2147483647 as key from alls),
a as (select *, {_lehmer('(key + (y * 8 + x) * 40014) % 2147483646 + 1', 3)} as s1 from k),
b as (select *, {_lehmer('s1', 3)} as s2 from a)""", body=f"""
select patch_id, channel, y, x, round(case when {_IMG} and {_u('noise')} < 0.3 then
  v + {_b(0.005, 0.02, 'noise_sd')} * sqrt(-2 * ln(s1 / 2147483647)) * cos(2 * pi() * (s2 / 2147483647)) else v end, 6) + 0.0 as v from b"""))
def _(spark, sf):
    return _out(aug.noise(_drawn(spark, sf)))


_TAPS = """bell as (select r, d, exp(-d * d / (2 * power(0.3e0 * (r - 1) + 0.8e0, 2))) as g
  from (select r, unnest(range(-r, r + 1)) as d from (select unnest([1, 2]) as r))),
taps as (select r, d, g / sum(g) over (partition by r) as w from bell)"""


@check("aug8_blur", sql(s.PATCHES, s.PATCH_MASK, _ALL, _TAPS, f"""
k as (select *, case when {_IMG} and {_u('blur')} < 0.2 then case when {_u('blur_size')} < 0.5 then 1 else 2 end else 0 end as r from alls)""",
    f"""down as (select k.patch_id, k.channel, k.r, k.y, k.x, sum(t.w * o.v) as v from k join taps t using (r)
  join k o on o.patch_id = k.patch_id and o.channel = k.channel and o.x = k.x and o.y = {s.mirrored('k.y + t.d', '8')} group by all)""",
    f"""both_ways as (select k.patch_id, k.channel, k.y, k.x, sum(t.w * o.v) as v from down k join taps t using (r)
  join down o on o.patch_id = k.patch_id and o.channel = k.channel and o.y = k.y and o.x = {s.mirrored('k.x + t.d', '8')} group by all)""",
    body="""select patch_id, channel, y, x, round(v, 6) as v from both_ways
union all select patch_id, channel, y, x, round(v, 6) from k where r = 0"""))
def _(spark, sf):
    return _out(aug.blur(_drawn(spark, sf)))


def _hole(i):
    h, w = (f"(2 + floor({_b(0, 4, f'{o}:{i}')}))" for o in ("hole_h", "hole_w"))
    y0, x0 = f"floor({_u(f'hole_y:{i}')} * (9 - {h}))", f"floor({_u(f'hole_x:{i}')} * (9 - {w}))"
    return f"(n > {i} and y >= {y0} and y < {y0} + {h} and x >= {x0} and x < {x0} + {w})"


@check("aug9_dropout", sql(s.PATCHES, s.PATCH_MASK, _ALL, f"k as (select *, 1 + floor({_b(0, 4, 'hole_count')}) as n from alls)", body=f"""
select patch_id, channel, y, x, round(case when {_IMG} and {_u('dropout')} < 0.2 and ({' or '.join(_hole(i) for i in range(4))})
  then 0 else v end, 6) + 0.0 as v from k"""))
def _(spark, sf):
    return _out(aug.dropout(_drawn(spark, sf)))


def _arrays(df):
    return _out(pt.unpack_patches(df))


def _warped(axis):
    """Source position per output position along one axis: five stretched steps, rescaled to the patch."""
    st = [f"(1 + {_b(-0.1, 0.1, f'stretch_{axis}:{i}')})" for i in range(5)]
    return f"""w{axis} as (
  select patch_id, on_, p, e[j + 1] + (e[j + 2] - e[j + 1]) * (p * 5 / 7 - j) as s from (
    select patch_id, on_, e, p, least(floor(p * 5 / 7), 4)::integer as j from (
      select patch_id, on_, list_transform(c, lambda v: v / c[6] * 7) as e, unnest(range(8)) as p from (
        select patch_id, {_u('distort')} < 0.2 as on_, [0, {', '.join(' + '.join(st[:k]) for k in range(1, 6))}] as c
        from (select distinct patch_id from patches)))))"""


@check("aug3_grid_distortion", sql(s.PATCHES, s.PATCH_MASK, _ALL, _warped("y"), _warped("x"), """
pos as (select a.patch_id, a.p as y, b.p as x, a.s as sy, b.s as sx, a.on_ from wy a join wx b using (patch_id)),
near as (select pos.*, floor(sy) as y0, floor(sx) as x0, sy - floor(sy) as fy, sx - floor(sx) as fx from pos where on_),
image as (select n.patch_id, i.channel, n.y, n.x, sum(i.v * (case when i.y = y0 then 1 - fy else fy end) * (case when i.x = x0 then 1 - fx else fx end)) as v
  from near n join patches i on i.patch_id = n.patch_id and i.y between y0 and y0 + 1 and i.x between x0 and x0 + 1 group by all)""",
    body="""select patch_id, channel, y, x, round(v, 6) as v from image
union all select n.patch_id, -1, n.y, n.x, round(m.v, 6) from near n
  join pmask m on m.patch_id = n.patch_id and m.y = floor(sy + 0.5) and m.x = floor(sx + 0.5)
union all select patch_id, channel, a.y, a.x, round(v, 6) from alls a join pos using (patch_id, y, x) where not on_"""))
def _(spark, sf):
    only = aug.Ranges(flip=0, rotate=0, transpose=0, tone=0, gamma=0, gain=0, noise=0, blur=0, dropout=0)
    both = t.patches(spark, sf).unionByName(t.patch_masks(spark, sf))
    return _arrays(aug.augment(both, EPOCH, SEED, only))


def _radiometric(out, src, op, prob, new):
    return f"""{out} as (select patch_id, channel, y, x, case when {_IMG} and {_u(op)} < {prob} then {new} else v end as v from {src})"""


#: The whole chain on ``alls``; the last table is ``a9``.
_CHAIN = (
    f"""a1 as (select patch_id, channel, case when {_u('flip_v')} < 0.5 then 7 - y else y end as y,
  case when {_u('flip_h')} < 0.5 then 7 - x else x end as x, v from alls)""",
    f"""k2 as (select *, case when {_u('rotate')} < 0.5 then floor({_b(0, 4, 'turns')}) else 0 end as k, {_u('transpose')} < 0.5 as tr from a1)""",
    """r2 as (select patch_id, channel, tr, v, case k when 0 then y when 1 then 7 - x when 2 then 7 - y else x end as ry,
  case k when 0 then x when 1 then y when 2 then 7 - x else 7 - y end as rx from k2)""",
    "a2 as (select patch_id, channel, case when tr then rx else ry end as y, case when tr then ry else rx end as x, v from r2)",
    _warped("y"), _warped("x"), """pos as (select a.patch_id, a.p as y, b.p as x, a.s as sy, b.s as sx, a.on_ from wy a join wx b using (patch_id))""",
    "near as (select pos.*, floor(sy) as y0, floor(sx) as x0, sy - floor(sy) as fy, sx - floor(sx) as fx from pos where on_)",
    """image3 as (select n.patch_id, i.channel, n.y, n.x, sum(i.v * (case when i.y = y0 then 1 - fy else fy end) * (case when i.x = x0 then 1 - fx else fx end)) as v
  from near n join a2 i on i.patch_id = n.patch_id and i.channel <> -1 and i.y between y0 and y0 + 1 and i.x between x0 and x0 + 1 group by all)""",
    """a3 as (select patch_id, channel, y, x, v from image3
  union all select n.patch_id, -1, n.y, n.x, m.v from near n
    join a2 m on m.patch_id = n.patch_id and m.channel = -1 and m.y = floor(sy + 0.5) and m.x = floor(sx + 0.5)
  union all select patch_id, channel, a.y, a.x, v from a2 a join pos using (patch_id, y, x) where not on_)""",
    _radiometric("a4", "a3", "tone", 0.4, f"least(greatest(v * (1 + {_b(-0.15, 0.15, 'contrast')}) + {_b(-0.15, 0.15, 'brightness')}, 0), 1)"),
    _radiometric("a5", "a4", "gamma", 0.3, f"power(greatest(v, 0), {_b(0.85, 1.15, 'gamma_value')})"),
    _radiometric("a6", "a5", "gain", 0.3, f"v * {_b(0.92, 1.08, 'gain_value', True)}"),
    f"""k7 as (select *, ('0x' || substr(md5('{SEED}:{EPOCH}:' || patch_id || ':noise_key:' || channel), 1, 8))::bigint % 2147483647 as key from a6)""",
    f"""m7 as (select *, {_lehmer('(key + (y * 8 + x)::bigint * 40014) % 2147483646 + 1', 3)} as s1 from k7)""",
    f"n7 as (select *, {_lehmer('s1', 3)} as s2 from m7)",
    _radiometric("a7", "n7", "noise", 0.3, f"v + {_b(0.005, 0.02, 'noise_sd')} * sqrt(-2 * ln(s1 / 2147483647)) * cos(2 * pi() * (s2 / 2147483647))"),
    _TAPS, f"""k8 as (select *, case when {_IMG} and {_u('blur')} < 0.2 then case when {_u('blur_size')} < 0.5 then 1 else 2 end else 0 end as r from a7)""",
    f"""down as (select k.patch_id, k.channel, k.r, k.y, k.x, sum(t.w * o.v) as v from k8 k join taps t using (r)
  join k8 o on o.patch_id = k.patch_id and o.channel = k.channel and o.x = k.x and o.y = {s.mirrored('k.y + t.d', '8')} group by all)""",
    f"""across as (select k.patch_id, k.channel, k.y, k.x, sum(t.w * o.v) as v from down k join taps t using (r)
  join down o on o.patch_id = k.patch_id and o.channel = k.channel and o.y = k.y and o.x = {s.mirrored('k.x + t.d', '8')} group by all)""",
    "a8 as (select patch_id, channel, y, x, v from across union all select patch_id, channel, y, x, v from k8 where r = 0)",
    f"k9 as (select *, 1 + floor({_b(0, 4, 'hole_count')}) as n from a8)",
    _radiometric("a9", "k9", "dropout", 0.2, f"case when {' or '.join(_hole(i) for i in range(4))} then 0 else v end"),
)


@check("aug10_compose", sql(s.PATCHES, s.PATCH_MASK, _ALL, *_CHAIN, once=True, body="""
select patch_id, channel::integer as channel, y::bigint as y, x::bigint as x, round(v, 6) + 0.0 as v from a9"""))
def _(spark, sf):
    both = t.patches(spark, sf).unionByName(t.patch_masks(spark, sf))
    return _arrays(aug.augment(both, EPOCH, SEED, RANGES))


@check("training_feed", sql(s.PATCHES, s.PATCH_MASK, _ALL, _SPLIT, *_CHAIN, f"""
place as (select patch_id, split, (row_number() over (partition by split order by case when split = 'train' then md5('{SEED}:{EPOCH}:' || patch_id) else patch_id end, patch_id) - 1) // 8 as batch_id from split),
fed as (select patch_id, channel, v from a9 join split using (patch_id) where split = 'train'
  union all select patch_id, channel, v from alls join split using (patch_id) where split <> 'train'),
st as (select channel, avg(v) as mean, greatest(stddev_pop(v), 1e-6) as std from patches group by channel)""", once=True, body="""
select split, batch_id, patch_id, f.channel::integer as channel, count(*)::integer as cells,
  round(max(case when st.mean is null then v else (v - st.mean) / st.std end), 6) + 0.0 as top
from fed f join place using (patch_id) left join st on st.channel = f.channel group by 1, 2, 3, 4"""))
def _(spark, sf):
    both = t.patches(spark, sf).unionByName(t.patch_masks(spark, sf))
    st = stats.channel_stats(_pixels(spark, sf))
    feed = training_feed(both, _split(spark, sf).select("patch_id", "split"), st, EPOCH, SEED, 8, RANGES)
    return feed.select("split", "batch_id", "patch_id", "channel", F.size("data").alias("cells"),
                       r6(F.array_max("data")).alias("top"))


# scoring ----------------------------------------------------------------------------------------
def mean_minus_height():
    """A stand-in model: the mean of the image channels against the height channel. A missing image cell
    adds nothing; without any, or without the height, there is no logit."""
    def run(batch):
        colours = np.where(np.isnan(batch[:, :4]).all(axis=1), np.nan, np.nansum(batch[:, :4], axis=1) / 4)
        return 4.0 * (colours - batch[:, 4])

    return run


_LOGITS = """lg as (select patch_id, y, x, 4 * (sum(v) filter (channel < 4) / 4 - max(v) filter (channel = 4)) as logit
  from patches group by patch_id, y, x)"""


@check("udf1_score_patches", sql(s.PATCHES, _LOGITS, body="""
select patch_id, y * 8 + x as pos, round(logit, 6) + 0.0 as logit from lg"""))
def _(spark, sf):
    out = scoring.score_patches(t.patches(spark, sf), mean_minus_height)
    return out.select("patch_id", F.posexplode("logits").alias("p", "v")).select(
        "patch_id", F.col("p").cast("bigint").alias("pos"), r6("v").alias("logit"))


@check("prj17_pseudo_rgb", sql(s.PATCHES, s.PATCH_MASK, _LOGITS, """
ends as (select patch_id, min(v) as lo, max(v) as hi from patches where channel < 3 group by patch_id),
wide as (select patch_id, y, x, max(v) filter (channel = 0) as r, max(v) filter (channel = 1) as g, max(v) filter (channel = 2) as b,
  max(v) filter (channel = 4) as ndsm from patches group by 1, 2, 3)""", body="""
select w.patch_id, w.y, w.x, round((r - lo) / (hi - lo + 1e-8), 6) as r, round((g - lo) / (hi - lo + 1e-8), 6) as g,
  round((b - lo) / (hi - lo + 1e-8), 6) as b, round(ndsm, 6) as ndsm, round(nullif(m.v, 255), 6) as gt,
  round(case when m.v <> 255 then 1 / (1 + exp(-logit)) end, 6) as pred_masked, round(1 / (1 + exp(-logit)), 6) as pred
from wide w join ends using (patch_id) join lg using (patch_id, y, x) join pmask m using (patch_id, y, x)"""))
def _(spark, sf):
    ids = t.patch_masks(spark, sf).select("patch_id", F.lit("val").alias("split"), F.lit(0).alias("batch_id"))
    preds = scoring.prediction_table(scoring.score_patches(t.patches(spark, sf), mean_minus_height), t.patch_masks(spark, sf), ids)
    out = scoring.pseudo_rgb(_pixels(spark, sf), preds)
    return rounded(out, "r", "g", "b", "ndsm", "gt", "pred_masked", "pred").withColumns(
        {"y": F.col("y").cast("bigint"), "x": F.col("x").cast("bigint")})


_BATCHED = """bs as (select patch_id, split, (row_number() over (partition by split order by patch_id) - 1) // 8 as batch_id from split)"""
_SCORED = """probs as (select split, batch_id, logit, 1 / (1 + exp(-logit)) as p, m.v as target, m.v <> 255 as valid
  from lg join pmask m using (patch_id, y, x) join bs using (patch_id)),
preds as (select * from probs)"""
_PAIRS = "thr as (select unnest([0.51e0, 0.62e0]) as thr), tthr as (select unnest([0.555e0, 0.655e0]) as tthr)"
_NAMES = "', '".join(mt.METRICS)


@check("evaluate_report", sql(s.PATCHES, s.PATCH_MASK, _LOGITS, _SPLIT, _BATCHED, _SCORED, _BATCH, _PAIRS, _CONF, _CLS, _AP, f"""
ev as (select split, tthr, thr, loss, acc, prec, rec, f1, iou, soft_iou, auc_pr from cls2
  join (select split, sum(({_COMBINED}) * n) / sum(n) as loss, (sum(spt) + 1e-6) / (sum(sp) + sum(st) - sum(spt) + 1e-6) as soft_iou
        from bt group by split) using (split) join ap using (split, tthr)),
l as (select split, tthr, thr, unnest(['{_NAMES}']) as metric, unnest([{", ".join(mt.METRICS)}]) as v from ev)""", body="""
select tthr, thr, metric, round(max(v) filter (split = 'train'), 4) as train, round(max(v) filter (split = 'val'), 4) as val,
  round(max(v) filter (split = 'test'), 4) as test from l group by all"""))
def _(spark, sf):
    feats = t.patches(spark, sf).unionByName(t.patch_masks(spark, sf))
    out = evaluate_model(feats, _split(spark, sf).select("patch_id", "split"), None, mean_minus_height, [0.51, 0.62], [0.555, 0.655],
                         mt.LossWeights(bce=0.3, dice=0.6, mae=0.3))
    return out.report
