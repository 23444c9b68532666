"""Session-level helpers shared by the operators: lineage cuts and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of written stage tables, in order; :func:`stage_scope` removes those made inside it.
_WRITTEN: list[str] = []


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions to use where AQE must not coalesce (row-generating stages)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the shared folder and continue from the written table.

    Used where a result must be the same in two branches of a plan (partition numbers after a
    sampled range shuffle) or must not be computed twice (per-raster scalars, grids read by several
    stages). The table survives lost executors, is read column by column, and its size is known to
    the optimiser. It stays until its :func:`stage_scope` ends or the folder is cleaned.
    """
    spark = df.sparkSession
    path = work_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, readable by every executor.

    Without ``spark.checkpoint.dir`` a temporary folder serves a local master, whose tasks all run on
    this machine; on a cluster it is an error, as no executor would see the others' files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.partition("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="rasterloom-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (streaming state, intermediate tables)."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Own the stage tables made inside the block and remove them at its end.

    Results that still have to be read must be written out before the block is left.
    """
    mark = len(_WRITTEN)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _WRITTEN[mark:]:
            where = hadoop.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del _WRITTEN[mark:]


def lookup_join(df: DataFrame, side: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a lookup that is usually small (one row per raster, channel or patch).

    The side is written once, so it is not recomputed and its size is exact: below
    ``spark.sql.autoBroadcastJoinThreshold`` the optimiser broadcasts it and the large side is not
    shuffled; above, it plans an ordinary join, whose skewed keys AQE splits.
    """
    return df.join(freeze(side), on, how)
