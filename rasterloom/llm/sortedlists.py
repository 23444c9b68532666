"""Exact inner-product search by aggregation of sorted lists without random access.

The rows are cut into blocks; a block holds one list of its rows per dimension, sorted by the entry.
For a query, the list of a dimension is read from its largest contribution on: from the top for a
positive query entry, from the bottom for a negative one. After a depth t the entry at the list's last
read position, the frontier, bounds what an unread row can add. A row's upper bound is the sum of what
was read of it and the frontiers of its other lists; its lower bound takes the lists' last entries
instead. Reading stops when no outsider can reach the kth best score, or the kth lower bound; the final
scores of the few rows left are then resolved exactly.

Queries that read to the same depth share the reading: what the lists have shown so far is one table
(rows x lists, the frontier where a list has not come to the row), and its product with the queries
gives all bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.vectors import BEST_SCHEMA, Best, best_rows, integer_vectors, matrix, merge_top, pieces
from rasterloom.runtime import freeze, work_folder

#: Rows of a block at most; its lists are a few megabytes.
BLOCK_ROWS = 4096
#: Depths, in shares of a block, at which bounds are looked at.
STEPS = 16
#: Queries whose bounds are formed at once.
BATCH = 512
#: Entries of all queries that are sent to every task at once.
PIECE_ENTRIES = 1 << 19
#: Sums up to this are exact in doubles.
EXACT = 2**53


class Queries:
    """A set of queries of one length: numbers, own ids, entries, and the best rows so far."""

    def __init__(self, numbers: list[int], ids: list[int | None], entries: np.ndarray, k: int):
        self.numbers, self.ids, self.entries, self.k = numbers, ids, entries, k
        q = entries.astype(np.float64)
        self.sides = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)  # for falling and rising lists
        self.best = [Best(k) for _ in numbers]
        self.kth = np.full(len(numbers), -np.inf)

    def add(self, n: int, scores: np.ndarray, ids: list[int | None]) -> None:
        self.best[n].add([int(s) for s in scores], ids)
        if self.best[n].kth() is not None:
            self.kth[n] = self.best[n].kth()


class Block:
    """The sorted lists of one block: ``x`` (rows x dimensions) and row numbers by dimension."""

    def __init__(self, ids: list[int | None], x: np.ndarray, order: np.ndarray):
        rows, d = x.shape
        self.ids, self.x, self.plain = ids, x, x.astype(np.float64)
        self.own: dict[int | None, list[int]] = {}
        for row, i in enumerate(ids):
            self.own.setdefault(i, []).append(row)
        self.up = np.take_along_axis(x.T, order, axis=1).astype(np.float64)
        self.place = np.empty((rows, d), np.int32)
        np.put_along_axis(self.place, order.T, np.arange(rows, dtype=np.int32)[:, None], axis=0)
        self.largest = int(np.abs(x).max(initial=0))
        self.ends = np.unique(-(-rows * np.arange(1, STEPS + 1) // STEPS))

    @staticmethod
    def sort(x: np.ndarray) -> np.ndarray:
        return np.argsort(x.T, axis=1, kind="stable")

    def _ends(self, depths: np.ndarray) -> np.ndarray:
        """Entries at some depths of the falling, then of the rising lists (depths x lists)."""
        return np.concatenate([self.up[:, len(self.x) - depths], self.up[:, depths - 1]]).T

    def _read(self, depth: int, rest: np.ndarray) -> np.ndarray:
        """What reading to a depth shows (rows x lists), with ``rest`` where a list has not come to a row."""
        rows, d = self.x.shape
        return np.concatenate([np.where(self.place >= rows - depth, self.plain, rest[:d]),
                               np.where(self.place < depth, self.plain, rest[d:])], axis=1)

    def search(self, queries: Queries) -> int:
        """Add this block's rows that can be among the best; rows with a query's id take no part.
        Returns the number of list entries read for all queries."""
        rows, d = self.x.shape
        entries = np.abs(queries.entries).max(axis=1, initial=0)
        scale = [int(e) * self.largest * max(1, d) for e in entries]
        slack = np.array([0.0 if s < EXACT else s * 1e-12 for s in scale])
        frontiers = self._ends(self.ends)
        outside = queries.sides @ frontiers.T + slack[:, None]  # what a row met in no list can reach
        top = (queries.sides @ self._ends(np.array([1])).T)[:, 0] + slack
        last = len(self.ends) - 1
        closed = outside < queries.kth[:, None]
        due = np.where(np.isneginf(queries.kth), last // 2, np.where(closed.any(axis=1), closed.argmax(axis=1), last))
        due[top < queries.kth] = -1  # nothing in this block can qualify
        read = 0
        for at, depth in enumerate(self.ends.tolist()):
            waiting = np.flatnonzero(due == at)
            if not len(waiting):
                continue
            shown = self._read(depth, frontiers[at]).T
            for some in np.split(waiting, range(BATCH, len(waiting), BATCH)):
                sides = queries.sides[some]
                upper, floor = sides @ shown, queries.kth[some] - slack[some]
                new = np.flatnonzero(np.isneginf(floor))
                if len(new):  # nothing is known yet: the kth lower bound
                    own = [self.own.get(queries.ids[n], []) for n in some[new]]
                    floor[new] = self._floors(sides[new], depth, queries.k, own) - slack[some[new]]
                reach = upper + slack[some, None] >= floor[:, None]
                # resolving n rows costs as much as reading n more positions of every list
                ready = (reach.sum(axis=1) <= rows // STEPS) | (at == last)
                due[some[~ready]] = min(at + 2, last)
                for i in np.flatnonzero(ready):
                    read += depth * int(np.count_nonzero(queries.entries[some[i]]))
                    self._resolve(queries, int(some[i]), np.flatnonzero(reach[i]), scale[some[i]])
        return read

    def _floors(self, sides: np.ndarray, depth: int, k: int, own: list[list[int]]) -> np.ndarray:
        """The kth lower bound of the rows but a query's own, for each query, after reading to a depth."""
        lower = sides @ self._read(depth, self._ends(np.array([len(self.x)]))[0]).T
        for bounds, rows in zip(lower, own):
            bounds[rows] = -np.inf
        return np.partition(lower, -k, axis=1)[:, -k] if len(self.x) >= k else np.full(len(sides), -np.inf)

    def _resolve(self, queries: Queries, n: int, left: np.ndarray, scale: int) -> None:
        own = self.own.get(queries.ids[n], [])
        if own:
            left = left[~np.isin(left, own)]
        q = queries.entries[n]
        if scale < EXACT:
            scores = self.plain[left] @ q.astype(np.float64)
        elif scale < 1 << 63:
            scores = self.x[left] @ q
        else:
            scores = self.x[left].astype(object) @ q.astype(object)
        best = queries.best[n].kth()
        if best is None and len(scores) > queries.k:
            best = np.partition(scores, -queries.k)[-queries.k]
        if best is not None:
            reach = scores >= best
            left, scores = left[reach], scores[reach]
        if len(left):
            queries.add(n, scores, [self.ids[i] for i in left])


def build_lists(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The list table of (id, x): blocks of rows of one length, each with its lists; narrow, written once."""

    def block(ids, parts):
        x = np.concatenate(parts)
        width = next(w for w in (2, 4, 8) if int(np.abs(x).max(initial=0)) < 1 << (8 * w - 1))
        return pa.RecordBatch.from_arrays([
            pa.array([x.shape[1]], pa.int32()), pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
            pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()),
            pa.array([Block.sort(x).astype("<u4").tobytes()], pa.binary())], names=["d", "width", "ids", "x", "sorted"])

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                some = batch.take(pa.array(np.flatnonzero(size == d)))
                ids, parts = held.setdefault(int(d), ([], []))
                ids += some.column(0).to_pylist()
                parts.append(matrix(some.column(1)).reshape(len(some), d))
                while len(ids) >= block_rows:
                    x = np.concatenate(parts)
                    yield block(ids[:block_rows], [x[:block_rows]])
                    ids[:], parts[:] = ids[block_rows:], [x[block_rows:]]
        for ids, parts in held.values():
            if ids:
                yield block(ids, parts)

    return freeze(vectors.mapInArrow(run, "d int, width int, ids array<bigint>, x binary, sorted binary"))


def search(lists: DataFrame, queries: DataFrame, k: int, piece_entries: int = PIECE_ENTRIES) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products per row of ``queries`` (id, x).

    Ties go to the smaller id, null ids last. Rows with the query's own id take no part; only
    vectors of equal length meet. Every query row is answered by itself, also if ids repeat. The
    queries go to the tasks in pieces of bounded size, one job per piece; a task carries its kth best
    score from block to block and hands on at most ``k`` rows per query. A score beyond 64 bits is an
    error.
    """
    spark = lists.sparkSession
    placed, count = pieces(queries.select("id", "x", F.greatest(F.size("x"), F.lit(1)).alias("entries")), "entries", piece_entries)
    folder = work_folder(spark, "found")
    for p in range(count):
        asked = placed.filter(F.col("piece") == p).select("number", "id", "x").collect()
        sent = spark.sparkContext.broadcast([(r["number"], r["id"], r["x"]) for r in asked])

        def run(batches, sent=sent):
            by_length: dict[int, list] = {}
            for q in sent.value:
                by_length.setdefault(len(q[2]), []).append(q)
            sets = {d: Queries([n for n, _, _ in some], [i for _, i, _ in some], np.array([x for *_, x in some], np.int64).reshape(len(some), d), k)
                    for d, some in by_length.items()}
            for batch in batches:
                for d, width, ids, x, order in zip(*(c.to_pylist() for c in batch.columns)):
                    entries = np.frombuffer(x, f"<i{width}").astype(np.int64).reshape(len(ids), d)
                    if d in sets:
                        Block(ids, entries, np.frombuffer(order, "<u4").reshape(d, len(ids))).search(sets[d])
            best = {n: b for found in sets.values() for n, b in zip(found.numbers, found.best)}
            yield from best_rows(TaskContext.get().partitionId(), best)

        lists.mapInArrow(run, BEST_SCHEMA).write.mode("append").parquet(folder)
        sent.destroy()
    if not count:
        spark.createDataFrame([], BEST_SCHEMA).write.parquet(folder)
    found = spark.read.schema(BEST_SCHEMA).parquet(folder)
    ranked = merge_top(found, "id", k)
    asked = placed.select("number", F.col("id").alias("query_id"))
    return ranked.join(asked, "number").select("query_id", "rank", "id", "score")


def top_products(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): rows whose id is divisible by ``every`` against all other rows."""
    vectors = integer_vectors(df, id_col, vector_col).withColumn("id", F.col("id").cast("bigint"))
    return search(build_lists(vectors), vectors.filter(F.col("id") % every == 0), k)
