"""Integer vectors from embeddings, query sets in bounded pieces, and merging of ranked rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators.prefix import prefix_sum
from rasterloom.runtime import freeze

#: Entries are multiplied by this before they are rounded down.
SCALE = 256
#: Scaled entries of this size or more have no integer form.
LARGEST = 2.0**62


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): every entry c of a vector as the integer floor(scale * c), computed in doubles.

    Rows whose vector is null or holds a null, infinite or NaN entry, or one whose integer would need
    more than 63 bits, are left out. An empty vector stays an empty one.
    """
    vector = F.col(f"`{vector_col}`")
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    usable = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return df.filter(usable).select(F.col(f"`{id_col}`").alias("id"), F.transform(scaled, lambda c: F.floor(c)).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of integer lists of equal length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def pieces(df: DataFrame, size_col: str, limit: int) -> tuple[DataFrame, int]:
    """The table with ``number`` (one per row) and ``piece``, and the number of pieces.

    Rows of one piece have sizes that sum to at most ``limit`` plus the size of one row, so a piece
    can be sent to every task. Written once: numbers are the same whenever it is read.
    """
    numbered = freeze(df.withColumn("number", F.monotonically_increasing_id()))
    before = F.col(f"cum_{size_col}") - F.col(size_col)
    placed = freeze(prefix_sum(numbered, [], "number", [size_col]).withColumn("piece", F.floor(before / limit)))
    most = placed.agg(F.max("piece")).first()[0]
    return placed.drop(f"cum_{size_col}", f"all_{size_col}"), 0 if most is None else most + 1


def merge_top(found: DataFrame, id_col: str, k: int) -> DataFrame:
    """``rank`` 1 to ``k`` per ``number`` by falling score, then ascending id, null ids last.

    ``found`` is a written table in which every ``task`` left its best rows. The rows of one number
    first meet in about the square root of that many groups, so no task gets a row set that grows with
    the number of tasks.
    """
    order = [F.desc("score"), F.asc_nulls_last(id_col)]
    groups = isqrt(found.agg(F.coalesce(F.max("task") + 1, F.lit(1))).first()[0])
    if groups > 4:
        some = W.partitionBy("number", F.col("task") % groups).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).drop("task")


class Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, [], []

    def kth(self):
        return self.scores[-1] if len(self.scores) == self.k else None

    def add(self, scores: list[int], ids: list[int | None]) -> None:
        pairs = sorted([*zip(self.scores, self.ids), *zip(scores, ids)], key=lambda p: (-p[0], p[1] is None, p[1] or 0))[:self.k]
        self.scores, self.ids = [s for s, _ in pairs], [i for _, i in pairs]


def best_rows(task: int, best: dict[int, Best]) -> Iterator[pa.RecordBatch]:
    """Record batches (number, task, id, score) of what a task has found."""
    numbers = [n for n, b in best.items() for _ in b.ids]
    if numbers:
        yield pa.RecordBatch.from_arrays([
            pa.array(numbers, pa.int64()), pa.array([task] * len(numbers), pa.int32()),
            pa.array([i for b in best.values() for i in b.ids], pa.int64()),
            pa.array([s for b in best.values() for s in b.scores], pa.int64())], names=["number", "task", "id", "score"])


#: Columns of :func:`best_rows`.
BEST_SCHEMA = "number bigint, task int, id bigint, score bigint"
