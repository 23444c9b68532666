"""Live evaluation metrics with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.pointwise import is_crown, is_valid, predicted, sigmoid
from rasterloom.operators.metrics import LossWeights, loss_terms, pixel_sums

RUNNING_KEYS = ["run_id", "epoch", "split"]


def _counts(p: Column, t: Column, thr: float, tthr: float) -> dict[str, Column]:
    v, pos, truth = is_valid(t), predicted(p, thr), is_crown(t, tthr)
    return {"tp": v & pos & truth, "fp": v & pos & ~truth, "fn": v & ~pos & truth, "tn": v & ~pos & ~truth}


def running_metrics(pixels: DataFrame, threshold: float, target_threshold: float) -> DataFrame:
    """Streaming totals per run, epoch and split from a stream of pixel rows: valid pixels,
    confusion counts and the absolute error. State grows with runs and epochs only."""
    p, t = sigmoid(F.col("logit")), F.col("target")
    valid = is_valid(t)
    return pixels.groupBy(*RUNNING_KEYS).agg(
        F.count_if(valid).alias("n_valid"),
        *[F.count_if(c).alias(n) for n, c in _counts(p, t, threshold, target_threshold).items()],
        F.sum(F.when(valid, F.abs(p - t)).otherwise(0.0)).alias("abs_error"))


def running_losses(batches: DataFrame, weights: LossWeights) -> DataFrame:
    """Streaming epoch loss from a stream with one row per prediction batch (``logits`` and
    ``targets`` arrays). The batch loss is a projection, so one stateful aggregation is enough."""
    zipped = F.filter(F.arrays_zip("logits", "targets"), lambda e: is_valid(e["targets"]))
    names = list(pixel_sums())

    def add(acc, e):
        sums = pixel_sums(e["logits"], e["targets"], sigmoid(e["logits"]))
        return F.struct(*[(acc[n] + sums[n]).alias(n) for n in names])

    start = F.struct(*[F.lit(0.0).alias(n) for n in names])
    rows = batches.select(*RUNNING_KEYS, F.size(zipped).alias("n"), F.aggregate(zipped, start, add).alias("s"))
    s = {n: F.col(f"s.{n}") for n in names} | {"n": F.col("n")}
    loss = sum((w * f(s) for w, (_e, f) in loss_terms(weights).values()), F.lit(0.0))
    return rows.groupBy(*RUNNING_KEYS).agg(
        F.sum("n").alias("n_valid"),
        F.sum(F.when(F.col("n") > 0, loss * F.col("n")).otherwise(0.0)).alias("loss_sum"))


def start_upsert(totals: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Keep the current totals under ``table``: every micro-batch writes a new version, the one before
    with the changed keys replaced, and removes what is older than that.

    A version is overwritten when its micro-batch is replayed, so a restart repeats nothing, and
    counts only when its write is complete. Readers always find at least one complete version.
    """

    def save(changed: DataFrame, version: int) -> None:
        spark = changed.sparkSession
        done = [v for v in _versions(spark, table) if v < version]
        if done:
            before = spark.read.schema(changed.schema).parquet(f"{table}/version={done[-1]}")
            changed = before.join(changed.select(*RUNNING_KEYS), RUNNING_KEYS, "left_anti").unionByName(changed)
        changed.write.mode("overwrite").parquet(f"{table}/version={version}")
        for old in done[:-1]:
            _folder(spark, f"{table}/version={old}", lambda files, path: files.delete(path, True))

    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_log(rows: DataFrame, sums: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, once: bool = True,
              merge_every: int = 16):
    """Totals as a log: every micro-batch adds one part with the sums of its own rows by key, ``sums(batch)``.

    Nothing is held between micro-batches, so finished runs and epochs cost nothing, and the work of a micro-batch
    follows its rows and keys, not all keys seen. Every ``merge_every`` parts become a new base, the sum of
    the base before and all parts since; the base before and its parts stay until the next one, for readers. A replayed
    micro-batch writes its part anew, and a base counts only parts above it, so nothing counts twice.
    """

    def save(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        sums(batch).write.mode("overwrite").parquet(f"{table}/part={version}")
        bases, parts = _versions(spark, table, "base"), _versions(spark, table, "part")
        if sum(p > (bases[-1] if bases else -1) for p in parts) < merge_every:
            return
        logged(spark, table).write.mode("overwrite").parquet(f"{table}/base={version}")
        old = bases[-1] if bases else -1
        for name in [f"base={b}" for b in bases if b < old] + [f"part={p}" for p in parts if p <= old]:
            _folder(spark, f"{table}/{name}", lambda files, path: files.delete(path, True))

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def logged(spark: SparkSession, table: str) -> DataFrame:
    """The current totals of a log: the newest complete base and the complete parts after it, summed by key."""
    bases = _versions(spark, table, "base")[-1:]
    names = [f"base={b}" for b in bases] + [f"part={p}" for p in _versions(spark, table, "part") if not bases or p > bases[0]]
    read = spark.read.parquet(*[f"{table}/{n}" for n in names])
    return read.groupBy(*RUNNING_KEYS).agg(*[F.sum(c).alias(c) for c in read.columns if c not in RUNNING_KEYS])


def _folder(spark: SparkSession, name: str, act):
    """``act`` on the file system of a folder and its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return act(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


def _versions(spark: SparkSession, table: str, kind: str = "version") -> list[int]:
    """Complete versions of a kind, ascending."""
    found = _folder(spark, f"{table}/{kind}=*/_SUCCESS", lambda files, path: files.globStatus(path))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The current totals: the newest complete version."""
    return spark.read.parquet(f"{table}/version={_versions(spark, table)[-1]}")
