"""Checks of run histories, run names and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.catalog import sqlparts as s
from rasterloom.catalog.registry import check, r6, rounded
from rasterloom.catalog.scores import P, W, _AP, _CLS, _CONF, _DICE
from rasterloom.catalog.sqlparts import sql
from rasterloom.functions import naming
from rasterloom.operators import history as hi
from rasterloom.plans.history_report import RECORDED, epoch_history, history_report
from rasterloom.runtime import work_folder
from rasterloom.sources import runstore, tables as t

PATIENCE = 10
M = t.HISTORY_METRICS
_STOP = f"""b as (select *, min(val_loss) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding) as best from hist),
hits as (select *, case when best is null or val_loss < best then epoch end as hit from b),
w as (select *, epoch - coalesce(max(hit) over (partition by run_id order by epoch), 0) as waited from hits),
stops as (select run_id, coalesce(min(epoch) filter (waited >= {PATIENCE}), max(epoch)) as stop_epoch, bool_or(waited >= {PATIENCE}) as stopped_early
  from w group by run_id)"""


@check("win9_early_stop", sql(s.HIST, _STOP, body="select * from stops"))
def _(spark, sf):
    return hi.early_stop(t.history(spark, sf), PATIENCE)


@check("win10_best_epoch", sql(s.HIST, _STOP, body="""
select run_id, arg_min(epoch, (val_loss, epoch)) as best_epoch, min(val_loss) as best_val_loss, max(stop_epoch) as stop_epoch
from hist join stops using (run_id) where epoch <= stop_epoch group by run_id"""))
def _(spark, sf):
    return hi.best_epoch(t.history(spark, sf), PATIENCE)


@check("snk7_history_roundtrip", sql(s.HIST, body="""
select run_id, phase, epoch, unnest(['loss', 'val_loss', 'f1', 'val_f1']) as metric,
       round(unnest([loss, val_loss, f1, val_f1]), 6) as value from hist"""))
def _(spark, sf):
    path = work_folder(spark, "history")
    runstore.save_history(hi.long_history(t.history(spark, sf)), path, M)
    return rounded(runstore.load_history(spark, path, M), "value")


@check("agg22_metric_panels", sql(s.HIST, body="""
select run_id, phase, epoch, unnest(['loss', 'auc_pr', 'f1', 'prec', 'rec', 'iou']) as panel,
  round(unnest([loss, 0, f1, 0, 0, 0]), 6) as train, round(unnest([val_loss, 0, val_f1, 0, 0, 0]), 6) as val from hist"""))
def _(spark, sf):
    return rounded(hi.metric_panels(t.history(spark, sf)), "train", "val")


@check("history_report", sql(s.HIST, _STOP, body="""
select run_id, max(stop_epoch) as stop_epoch, count(*) as epochs, round(min(val_loss), 6) as best_val_loss, round(max(loss), 6) as top_loss
from hist join stops using (run_id) where epoch <= stop_epoch group by run_id"""))
def _(spark, sf):
    rep = history_report(t.history(spark, sf), PATIENCE)
    seen = rep.panels.filter("panel = 'loss'").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("epochs"), r6(F.max("train")).alias("top_loss"))
    return rep.best.join(seen, "run_id").select("run_id", "stop_epoch", "epochs", r6("best_val_loss").alias("best_val_loss"), "top_loss")


_BY = "run_id, epoch, split"
_EPOCH_AP = _AP.replace("group by 1, 2, 3)", "group by 1, 2, 3, 4, 5)").replace("group by 1, 2)", "group by 1, 2, 3, 4)").replace(
    "split, tthr", f"{_BY}, tthr")
_EPOCH_CONF = _CONF.replace("split, tthr, thr", f"{_BY}, tthr, thr")
_WIDE = ", ".join(f"""round(coalesce(max({c}) filter (split = 'train'), max(0) filter (split = 'train')), 6) as {c},
  round(coalesce(max({c}) filter (split = 'val'), max(0) filter (split = 'val')), 6) as val_{c}""" for c in RECORDED)


@check("epoch_history", sql(*P, """bt as (select run_id, epoch, split, batch_id, count(*) as n, sum(abs(p - target)) as sab,
  sum(p) as sp, sum(target) as st, sum(p * target) as spt, sum(greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit)))) as bce
  from probs where valid group by 1, 2, 3, 4)""", "thr as (select 0.61e0 as thr), tthr as (select 0.65e0 as tthr)", _EPOCH_CONF, _CLS, _EPOCH_AP, f"""
ep as (select run_id, epoch, split, sum((0.3 * bce / n + 0.6 * {_DICE} + 0.3 * sab / n) * n) / sum(n) as loss,
  (sum(spt) + 1e-6) / (sum(sp) + sum(st) - sum(spt) + 1e-6) as soft_iou from bt group by 1, 2, 3),
every as (select c.run_id, c.epoch, c.split, loss, soft_iou, auc_pr, f1, iou, prec, rec from cls2 c
  left join ep using (run_id, epoch, split) left join ap using (run_id, epoch, split))""",
    body=f"""select run_id, 'tl' as phase, epoch, {_WIDE} from every where split in ('train', 'val') group by run_id, epoch"""))
def _(spark, sf):
    wide = epoch_history(t.predictions(spark, sf), W, threshold=0.61, target_threshold=0.65)
    names = [x for c in RECORDED for x in (c, f"val_{c}")]
    return rounded(wide.select("run_id", "phase", "epoch", *names), *names)


# names ------------------------------------------------------------------------------------------
def _runs(spark, sf):
    """Run parameters per part."""
    k = F.col("p_partkey")
    methods = F.array(*[F.lit(x) for x in ("local_min", "dtm", "gradient", "both")])
    return t.table(spark, sf, "part").select(
        k, F.element_at(methods, (k % 4 + 1).cast("int")).alias("method"),
        F.when(k % 3 == 0, "or").otherwise("and").alias("combine"),
        F.array((k % 7 * 100).cast("int"), (k % 5 * 100 + 50).cast("int")).alias("windows"),
        (1.0 + (k % 9).cast("double") / 10).alias("ht"), ((k % 6).cast("double") / 2).alias("sigma"),
        (k % 8 >= 4).alias("dtm"))


_NUM = lambda e: f"regexp_replace(printf('%.6f', {e}), '(\\.\\d+?)0+$', '\\1')"
_HT, _SG = _NUM("1.0e0 + (p_partkey % 9)::double / 10"), _NUM("(p_partkey % 6)::double / 2")
_RUN_NAME = f"""names as (select p_partkey,
  '_lm_w' || (p_partkey % 7 * 100) || '-' || (p_partkey % 5 * 100 + 50) || '_ht' || {_HT} as lm, '_dtm_ht' || {_HT} as dt, '_gr_s' || {_SG} as gr,
  case when p_partkey % 3 = 0 then 'or' else 'and' end as combine, p_partkey % 8 >= 4 as has_dtm from part),
run as (select p_partkey, case p_partkey % 4 when 0 then lm when 1 then dt when 2 then gr
  else (case when has_dtm then dt else lm end) || gr || '_' || combine end as name from names)"""


def _named(spark, sf):
    c = F.col
    return _runs(spark, sf).withColumn("name", naming.run_name(c("method"), c("combine"), c("windows"), c("ht"), c("sigma"), c("dtm")))


@check("str2_run_name", sql(_RUN_NAME, body="select p_partkey, name from run"))
def _(spark, sf):
    return _named(spark, sf).select("p_partkey", "name")


@check("snk9_run_registry", sql(_RUN_NAME, body="""
select printf('run%d', p_partkey // 500) as run_id, name, 'masks/final' || name || '.tif' as mask_path, p_partkey::varchar as part from run"""))
def _(spark, sf):
    path = work_folder(spark, "registry")
    k = F.col("p_partkey")
    rows = _named(spark, sf).select(
        F.format_string("run%d", F.floor(k / 500)).alias("run_id"), "name",
        F.create_map(F.lit("part"), k.cast("string"), F.lit("method"), F.col("method")).alias("params"),
        naming.with_suffix(F.lit("masks/final.tif"), F.col("name")).alias("mask_path"),
        F.lit(None).cast("string").alias("ndsm_path"))
    runstore.register_run(rows, path)
    back = runstore.read_registry(spark, path)
    return back.select("run_id", "name", "mask_path", F.col("params")["part"].alias("part"))


@check("str3_experiment_id", """
with w as (select p_partkey, p_name, case p_partkey % 3 when 0 then 'weights/' || p_brand || '.best.pt' when 1 then p_brand end as weights,
  (p_partkey % 5)::double / 10 as bce, (p_partkey % 4)::double / 4 as dice, case when p_partkey % 7 = 0 then 'v2' when p_partkey % 7 = 1 then '' end as tag from part),
parts as (select p_partkey, 'segmenter' as m, case when contains(weights, '/') then regexp_replace(regexp_extract(weights, '([^/]+)$', 1), '\\.[^.]*$', '') else weights end as w,
  nullif(concat_ws('_', case when bce > 0 then 'bce' || regexp_replace(printf('%.6f', bce), '\\.?0+$', '') end,
                        case when dice > 0 then 'dice' || regexp_replace(printf('%.6f', dice), '\\.?0+$', '') end), '') as l, nullif(tag, '') as tag from w)
select p_partkey, concat_ws('__', m, w, l, tag) as experiment_id from parts""")
def _(spark, sf):
    k = F.col("p_partkey")
    weights = F.when(k % 3 == 0, F.concat(F.lit("weights/"), F.col("p_brand"), F.lit(".best.pt"))).when(k % 3 == 1, F.col("p_brand"))
    losses = {"bce": (k % 5).cast("double") / 10, "dice": (k % 4).cast("double") / 4, "iou": F.lit(0.0)}
    tag = F.when(k % 7 == 0, "v2").when(k % 7 == 1, "")
    return t.table(spark, sf, "part").select(k, naming.experiment_id(F.lit("segmenter"), weights, losses, tag).alias("experiment_id"))
