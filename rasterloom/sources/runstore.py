"""Run history, evaluation text and the run registry on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.history import long_history, wide_history

REGISTRY_SCHEMA = "run_id string, name string, params map<string,string>, mask_path string, ndsm_path string"


def save_history(history: DataFrame, path: str, metrics: list[str]) -> None:
    """Wide CSV, values rounded to eight decimals, one folder per phase; runs are ranges of rows, so
    the number of files does not follow the number of runs."""
    wide = wide_history(history, metrics).select("run_id", "phase", "epoch", *metrics)
    order = ("phase", "run_id", "epoch")  # ranges, so a very long run is written by several tasks
    wide.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "phase").option("header", True).csv(path)


def load_history(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Back to long form."""
    schema = "run_id bigint, epoch bigint, " + ", ".join(f"{m} double" for m in metrics) + ", phase string"
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return long_history(wide.select("run_id", "phase", "epoch", *metrics))


def report_lines(report: DataFrame) -> DataFrame:
    """Text lines ``metric: value`` per threshold pair and split, from the wide report."""
    long = report.unpivot(["tthr", "thr", "metric"], ["train", "val", "test"], "split", "value")
    text = F.format_string("[tgt>=%s pred>=%s] %s %s: %.4f", F.col("tthr").cast("string"),
                           F.col("thr").cast("string"), F.col("split"), F.col("metric"), F.col("value"))
    return long.select(text.alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report_lines(report).sort("value").write.mode("overwrite").text(path)


def register_run(entry: DataFrame, path: str) -> None:
    """Append runs to the registry, sorted by run id so that a reader's filter skips row groups."""
    entry.sortWithinPartitions("run_id").write.mode("append").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)
