"""Checks of losses, metrics and evaluation tables, and their streaming form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.catalog import sqlparts as s
from rasterloom.catalog.registry import check, r6, rounded
from rasterloom.catalog.sqlparts import sql
from rasterloom.functions import pointwise as pw
from rasterloom.operators import history as hi, metrics as mt
from rasterloom.runtime import work_folder
from rasterloom.sources import runstore, tables as t
from rasterloom.streaming import metric_stream as ms, patch_stream as ps

THR, TTHR = [0.61, 0.79], [0.65, 0.75]
W = mt.LossWeights(bce=0.3, dice=0.6, mae=0.3)
P = (s.PREDS, s.PROBS)
_BATCH = """bt as (select split, batch_id, count(*) as n,
  sum(greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit)))) as bce, sum(p) as sp, sum(target) as st, sum(p * target) as spt,
  sum(p * p) as spp, sum(target * target) as stt, sum(abs(p - target)) as sab
  from probs where valid group by split, batch_id),
every as (select distinct split, batch_id from preds)"""
_GRID = "thr as (select unnest([0.61e0, 0.79e0]) as thr), tthr as (select unnest([0.65e0, 0.75e0]) as tthr)"
_CONF = """conf as (select split, tthr, thr,
  count(*) filter (valid and p >= thr and target > tthr) as tp, count(*) filter (valid and p >= thr and not target > tthr) as fp,
  count(*) filter (valid and not p >= thr and target > tthr) as fn, count(*) filter (valid and not p >= thr and not target > tthr) as tn
  from probs, thr, tthr group by split, tthr, thr)"""
_CLS = """cls as (select *, case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) else 0 end as acc,
  case when tp + fp > 0 then tp / (tp + fp) else 0 end as prec, case when tp + fn > 0 then tp / (tp + fn) else 0 end as rec,
  case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 0 end as iou from conf),
cls2 as (select *, case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0 end as f1 from cls)"""
_AP = """sc as (select split, tthr, logit, count(*) as n, count(*) filter (target > tthr) as h from probs, tthr where valid group by 1, 2, 3),
cum as (select split, tthr, h, sum(h) over w as ch, sum(n) over w as cn, sum(h) over a as th, sum(n) over a as tn
  from sc window w as (partition by split, tthr order by logit desc), a as (partition by split, tthr)),
ap as (select split, tthr, case when max(th) > 0 and max(th) < max(tn) then sum(h * ch / cn) / max(th) else 0 end as auc_pr from cum group by 1, 2)"""


@check("prj13_sigmoid", sql(*P, body="select run_id, epoch, split, batch_id, logit, round(p, 6) as p from probs"))
def _(spark, sf):
    return t.predictions(spark, sf).select("run_id", "epoch", "split", "batch_id", "logit", r6(pw.sigmoid(F.col("logit"))).alias("p"))


@check("prj14_binarise", sql(*P, body="select batch_id, split, logit, p >= 0.61e0 as pred, target > 0.65e0 as truth from probs"))
def _(spark, sf):
    p = pw.sigmoid(F.col("logit"))
    return t.predictions(spark, sf).select("batch_id", "split", "logit", pw.predicted(p, 0.61).alias("pred"),
                                           pw.is_crown(F.col("target"), 0.65).alias("truth"))


@check("join7_threshold_grid", sql(*P, _GRID, body="""
select split, tthr, thr, n from (select split, count(*) as n from preds group by split), thr, tthr"""))
def _(spark, sf):
    n = t.predictions(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return mt.threshold_table(n, THR, TTHR).select("split", "tthr", "thr", "n")


@check("agg9_confusion", sql(*P, _GRID, _CONF, body="select * from conf"))
def _(spark, sf):
    return mt.confusion(t.predictions(spark, sf), THR, TTHR)


@check("agg10_classification_metrics", sql(*P, _GRID, _CONF, _CLS, body="""
select split, tthr, thr, round(acc, 6) as acc, round(prec, 6) as prec, round(rec, 6) as rec, round(f1, 6) as f1, round(iou, 6) as iou from cls2"""))
def _(spark, sf):
    m = mt.classification_metrics(mt.confusion(t.predictions(spark, sf), THR, TTHR))
    return rounded(m.drop("tp", "fp", "fn", "tn"), "acc", "prec", "rec", "f1", "iou")


@check("agg11_soft_iou", sql(*P, body="""
select split, round((sum(p * target) + 1e-6) / (sum(p + target - p * target) + 1e-6), 6) as soft_iou from probs where valid group by split"""))
def _(spark, sf):
    return rounded(mt.soft_iou(t.predictions(spark, sf)), "soft_iou")


@check("agg12_average_precision", sql(*P, _GRID, _AP, body="select split, tthr, round(auc_pr, 6) as auc_pr from ap"))
def _(spark, sf):
    return rounded(mt.average_precision(t.predictions(spark, sf), TTHR), "auc_pr")


def _loss_check(name, weights, expr, cols="loss"):
    @check(name, sql(*P, _BATCH, body=f"""
select split, batch_id, coalesce(n, 0) as n_valid, round(coalesce({expr}, 0), 6) as loss
from every left join bt using (split, batch_id)"""))
    def _(spark, sf):
        b = mt.batch_losses(t.predictions(spark, sf), weights)
        return b.select("split", "batch_id", "n_valid", r6("loss").alias("loss"))


_DICE = "(1 - (2 * spt + 1e-6) / (sp + st + 1e-6))"
_loss_check("agg13_bce", mt.LossWeights(bce=1.0), "bce / n")
_loss_check("agg14_dice_loss", mt.LossWeights(dice=1.0), _DICE)
_loss_check("agg14_dice_loss_squared", mt.LossWeights(dice=1.0, dice_squared=True), "1 - (2 * spt + 1e-6) / (spp + stt + 1e-6)")
_loss_check("agg15_iou_loss", mt.LossWeights(iou=1.0), "1 - (spt + 1e-6) / (sp + st - spt + 1e-6)")
_loss_check("agg16_mae_loss", mt.LossWeights(mae=1.0), "sab / n")

_COMBINED = f"0.3 * bce / n + 0.6 * {_DICE} + 0.3 * sab / n"


@check("agg17_combined_loss", sql(*P, _BATCH, body=f"""
select split, batch_id, coalesce(n, 0) as n_valid, round(coalesce({_COMBINED}, 0), 6) as loss, round(coalesce(0.3 * bce / n, 0), 6) as loss_bce,
  round(coalesce(0.6 * {_DICE}, 0), 6) as loss_dice, round(coalesce(0.3 * sab / n, 0), 6) as loss_mae
from every left join bt using (split, batch_id)"""))
def _(spark, sf):
    return rounded(mt.batch_losses(t.predictions(spark, sf), W), "loss", "loss_bce", "loss_dice", "loss_mae")


@check("agg18_epoch_loss", sql(*P, _BATCH, body=f"""
select split, sum(n)::bigint as n_valid, round(sum(({_COMBINED}) * n) / sum(n), 6) as loss, round(sum(0.3 * bce) / sum(n), 6) as loss_bce,
  round(sum(0.6 * {_DICE} * n) / sum(n), 6) as loss_dice, round(sum(0.3 * sab) / sum(n), 6) as loss_mae from bt group by split"""))
def _(spark, sf):
    e = mt.epoch_loss(mt.batch_losses(t.predictions(spark, sf), W))
    return rounded(e, "loss", "loss_bce", "loss_dice", "loss_mae")


_EVAL = (*P, _BATCH, _GRID, _CONF, _CLS, _AP, f"""
ev as (select split, tthr, thr, loss, acc, prec, rec, f1, iou, soft_iou, auc_pr from cls2
  join (select split, sum(({_COMBINED}) * n) / sum(n) as loss, (sum(spt) + 1e-6) / (sum(sp) + sum(st) - sum(spt) + 1e-6) as soft_iou
        from bt group by split) using (split) join ap using (split, tthr))""")
_R = ", ".join(f"round({c}, 6) as {c}" for c in mt.METRICS)


def _evaluated(spark, sf):
    return mt.evaluate(t.predictions(spark, sf), THR, TTHR, W)


@check("agg19_evaluate", sql(*_EVAL, body=f"select split, tthr, thr, {_R} from ev"))
def _(spark, sf):
    return rounded(_evaluated(spark, sf), *mt.METRICS)


@check("agg20_pixel_metrics", sql(*P, "thr as (select 0.61e0 as thr), tthr as (select 0.65e0 as tthr)", _CONF.replace("split, tthr, thr,", "tthr, thr,").replace(
    "group by split, tthr, thr", "group by tthr, thr"), _CLS, body="""
select tp, fp, fn, tn, round(acc, 6) as acc, round(prec, 6) as prec, round(rec, 6) as rec, round(f1, 6) as f1, round(iou, 6) as iou from cls2"""))
def _(spark, sf):
    return rounded(mt.pixel_metrics(t.predictions(spark, sf), 0.61, 0.65), "acc", "prec", "rec", "f1", "iou")


@check("agg22_evaluation_panels", sql(*_EVAL, body="""
select metric, tthr, thr, round(coalesce(max(v) filter (split = 'train'), 0), 6) as train, round(coalesce(max(v) filter (split = 'val'), 0), 6) as val,
  round(coalesce(max(v) filter (split = 'test'), 0), 6) as test
from (select split, tthr, thr, unnest(['auc_pr', 'f1', 'iou', 'prec', 'rec', 'acc']) as metric,
      unnest([auc_pr, f1, iou, prec, rec, acc]) as v from ev) group by 1, 2, 3"""))
def _(spark, sf):
    return rounded(hi.evaluation_panels(_evaluated(spark, sf)), "train", "val", "test")


@check("snk8_eval_report", sql(*_EVAL, body="""
select '[tgt>=' || tthr || ' pred>=' || thr || '] ' || split || ' ' || metric || ': ' || printf('%.4f', round(v, 4)) as line
from (select split, tthr, thr, unnest(['loss', 'acc', 'prec', 'rec', 'f1', 'iou', 'soft_iou', 'auc_pr']) as metric,
      unnest([loss, acc, prec, rec, f1, iou, soft_iou, auc_pr]) as v from ev)"""))
def _(spark, sf):
    path = work_folder(spark, "report")
    runstore.write_report(mt.eval_report(_evaluated(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@check("set2_concat_batches", sql(*P, body="select split, batch_id, count(*) as n, round(sum(target), 6) as total from preds group by 1, 2"))
def _(spark, sf):
    p = t.predictions(spark, sf)
    parts = [p.filter(F.col("split") == x) for x in ("train", "val", "test")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("split", "batch_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("target")).alias("total"))


@check("udf3_custom_loss_term", sql(*P, """sq as (select split, batch_id, count(*) as n, sum(power(p - target, 2)) as e from probs where valid group by 1, 2),
every as (select distinct split, batch_id from preds)""", _BATCH.split(",\nevery")[0], body=f"""
select split, batch_id, coalesce(sq.n, 0) as n_valid, round(coalesce(0.5 * e / sq.n + 0.6 * {_DICE}, 0), 6) as loss,
  round(coalesce(0.6 * {_DICE}, 0), 6) as loss_dice, round(coalesce(0.5 * e / sq.n, 0), 6) as loss_mse
from every left join sq using (split, batch_id) left join bt using (split, batch_id)"""))
def _(spark, sf):
    diff = F.col("p") - F.col("target")
    mse = ({"sq": diff * diff}, lambda q: q["sq"] / q["n"])
    b = mt.batch_losses(t.predictions(spark, sf), mt.LossWeights(dice=0.6), extra={"mse": (0.5, mse)})
    return rounded(b, "loss", "loss_dice", "loss_mse")


# streaming --------------------------------------------------------------------------------------
def _stream(spark, sf, name):
    """A stream over one of the test tables, a file or a folder of files, one file per micro-batch."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # a pattern, as a stream's plain path has to be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/{name}[.]parquet")


_LIVE_SQL = sql(*P, body="""
select run_id, epoch, split, count(*) filter (valid) as n_valid, count(*) filter (valid and p >= 0.61 and target > 0.65) as tp,
  count(*) filter (valid and p >= 0.61 and not target > 0.65) as fp, count(*) filter (valid and not p >= 0.61 and target > 0.65) as fn,
  count(*) filter (valid and not p >= 0.61 and not target > 0.65) as tn, round(coalesce(sum(abs(p - target)) filter (valid), 0), 6) as abs_error
from probs group by 1, 2, 3""")


@check("stm1_metric_stream", _LIVE_SQL)
def _(spark, sf):
    base = work_folder(spark, "metric-stream")
    live = ms.running_metrics(t.as_predictions(_stream(spark, sf, "events")), 0.61, 0.65)
    ms.start_upsert(live, f"{base}/table", f"{base}/state").awaitTermination()
    return rounded(ms.latest(spark, f"{base}/table"), "abs_error")


@check("stm1_metric_log", _LIVE_SQL)
def _(spark, sf):
    base = work_folder(spark, "metric-log")
    sums = lambda batch: ms.running_metrics(batch, 0.61, 0.65)
    ms.start_log(t.as_predictions(_stream(spark, sf, "events")), sums, f"{base}/table", f"{base}/state").awaitTermination()
    return rounded(ms.logged(spark, f"{base}/table"), "abs_error")


@check("stm1_running_loss", sql(*P, _BATCH.replace("split, batch_id", "run_id, epoch, split, batch_id"), body=f"""
select k.run_id, k.epoch, k.split, coalesce(sum(n), 0)::bigint as n_valid, round(coalesce(sum(({_COMBINED}) * n) / sum(n), 0), 6) as loss
from every k left join bt using (run_id, epoch, split, batch_id) group by 1, 2, 3"""))
def _(spark, sf):
    """A stream with a row per prediction batch; the state is the valid-weighted sum of batch losses."""
    base = work_folder(spark, "loss-stream")
    cell = F.struct("logit", "target")
    rows = t.predictions(spark, sf).groupBy("run_id", "epoch", "split", "batch_id").agg(F.collect_list(cell).alias("c"))
    arrivals = rows.select("run_id", "epoch", "split", F.col("c.logit").alias("logits"), F.col("c.target").alias("targets"))
    arrivals.repartition(3).write.parquet(f"{base}/arrivals")
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrivals")
    ms.start_upsert(ms.running_losses(stream, W), f"{base}/table", f"{base}/state").awaitTermination()
    mean = F.when(F.col("n_valid") > 0, F.col("loss_sum") / F.col("n_valid")).otherwise(0.0)
    return ms.latest(spark, f"{base}/table").select("run_id", "epoch", "split", F.col("n_valid").cast("bigint").alias("n_valid"), r6(mean).alias("loss"))


@check("stm2_patch_ingest", """
with e as (select vec_id, embedding as b from embeddings)
select printf('%05d_%d_ms4', vec_id // 5, vec_id % 5) as name, cast(vec_id // 5 as integer) as pr, cast(vec_id % 5 as integer) as pc,
  len(list_filter(b, lambda v: v < -0.08)) / 64 as mask_nodata, len(list_filter(b, lambda v: abs(v) < 0.02)) / 64 as image_zero,
  case when len(list_filter(b, lambda v: v < -0.08)) / 64 > 0.3 then 'skipped_mask'
       when len(list_filter(b, lambda v: abs(v) < 0.02)) / 64 > 0.15 then 'skipped_img' else 'kept' end as status
from e""")
def _(spark, sf):
    base = work_folder(spark, "patch-stream")
    k = F.col("vec_id")
    rows = _stream(spark, sf, "embeddings").select(
        F.format_string("%05d_%d_ms4", F.floor(k / 5), k % 5).alias("name"),
        F.transform("embedding", lambda v: F.when(v < F.lit(-0.08), 255.0).otherwise(0.5)).alias("mask"),
        F.array(F.transform("embedding", lambda v: F.when(F.abs(v) < F.lit(0.02), 0.0).otherwise(v.cast("double")))).alias("bands"))
    ps.start_ingest(ps.check_arrivals(rows, 0.3, 0.15), f"{base}/table", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/table")
