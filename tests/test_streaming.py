"""Streams give the same totals as batch, also when files arrive one by one."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import metrics as mt
from rasterloom.plans.history_report import epoch_history
from rasterloom.streaming import metric_stream as ms

SCHEMA = "run_id bigint, epoch bigint, split string, batch_id bigint, logit double, target double"


def rows(seed, n=400):
    rng = np.random.default_rng(seed)
    return [(1, int(rng.integers(1, 3)), ["train", "val"][int(rng.integers(2))], seed * 10 + i // 40,
             float(rng.normal()), float(rng.choice([0.0, 0.3, 0.9, 255.0]))) for i in range(n)]


def test_pixel_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(4):
        spark.createDataFrame(rows(i), SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    ms.start_upsert(ms.running_metrics(stream, 0.5, 0.5), out, str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "out").glob("version=*"))) == 2
    got = {(r.epoch, r.split): (r.tp, r.fp, r.fn, r.tn, r.n_valid) for r in ms.latest(spark, out).collect()}
    want = mt.confusion(spark.read.parquet(src), [0.5], [0.5], ("epoch", "split")).collect()
    assert got == {(r.epoch, r.split): (r.tp, r.fp, r.fn, r.tn, r.tp + r.fp + r.fn + r.tn) for r in want}


def test_batch_stream_loss_equals_batch_loss(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    w = mt.LossWeights(bce=0.3, dice=0.6, mae=0.3)
    pixels = spark.createDataFrame([r for i in range(3) for r in rows(i)], SCHEMA)
    packed = pixels.groupBy("run_id", "epoch", "split", "batch_id").agg(
        F.collect_list("logit").alias("logits"), F.collect_list("target").alias("targets"))
    packed.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ms.start_upsert(ms.running_losses(stream, w), out, str(tmp_path / "state")).awaitTermination()
    got = {(r.epoch, r.split): r.loss_sum / r.n_valid for r in ms.latest(spark, out).collect()}
    for r in epoch_history(pixels, w).collect():
        assert abs(got[r.epoch, "train"] - r.loss) < 1e-9
        assert abs(got[r.epoch, "val"] - r.val_loss) < 1e-9


def test_log_of_sums_equals_batch_over_restarts(spark, tmp_path):
    """Parts merge into bases, a replayed micro-batch counts once, an unfinished base is not read."""
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    sums = lambda batch: ms.running_metrics(batch, 0.5, 0.5)
    for stage in range(3):
        for i in range(4):
            spark.createDataFrame(rows(stage * 4 + i, 120), SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        ms.start_log(stream, sums, out, state, merge_every=3).awaitTermination()
        want = sorted(map(tuple, sums(spark.read.parquet(src)).drop("abs_error").collect()))
        assert sorted(map(tuple, ms.logged(spark, out).drop("abs_error").collect())) == want
    folders = {p.name for p in (tmp_path / "out").iterdir()}
    assert {"base=11", "base=8"} <= folders and len(folders) <= 5
    last = spark.read.parquet(f"{out}/part=11") if "part=11" in folders else None
    assert last is not None
    (tmp_path / "out" / "base=12").mkdir()  # begun, never completed
    (tmp_path / "state" / "commits" / "11").unlink()  # the last micro-batch runs again
    (tmp_path / "state" / "commits" / ".11.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    ms.start_log(stream, sums, out, state, merge_every=3).awaitTermination()
    assert sorted(map(tuple, ms.logged(spark, out).drop("abs_error").collect())) == want


def test_table_streams_from_a_file_or_a_folder(spark, tmp_path):
    from rasterloom.catalog.scores import _stream

    one = spark.range(6).coalesce(1)
    one.write.parquet(str(tmp_path / "a" / "events.parquet"))
    one.union(one).repartition(3).write.parquet(str(tmp_path / "b" / "events.parquet"))
    (tmp_path / "c").mkdir()
    part, = (tmp_path / "a" / "events.parquet").glob("part-*.parquet")
    (tmp_path / "c" / "events.parquet").symlink_to(part)
    for name, n in (("a", 6), ("b", 12), ("c", 6)):
        out = str(tmp_path / f"out-{name}")
        _stream(spark, str(tmp_path / name), "events").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == n
