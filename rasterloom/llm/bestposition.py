"""Ranked lexical search with the Best Position Algorithm over impact-ordered lists.

Documents are cut into blocks. In a block every term of the queries has an impact list: the documents
that hold it, by falling impact. A query reads its lists side by side; a document met in one of them is
scored in full by direct accesses, and with that all its positions in all lists are seen. The best
position of a list is the end of its unbroken run of seen positions from the top. A document not met
yet stands below every best position, so the sum of the impacts there bounds its score; that bound is
at most the one of the last positions read, as direct accesses lengthen the runs. A block is left as
soon as the bound is strictly below the k-th best score, so ties are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import alnum_words, map_text
from rasterloom.llm.vectors import BEST_SCHEMA, Best, best_rows, merge_top, pieces
from rasterloom.runtime import freeze, work_folder

#: Documents of a block at most, and cells of its direct-access table (terms x documents) at most.
BLOCK_DOCS, BLOCK_CELLS = 4096, 1 << 24
#: Distinct terms per query, summed over the queries that are asked at once: a bound for what is sent
#: to the tasks (one query more may fit in).
PIECE_TERMS = 1 << 15
#: Positions of every list read in the first round; each round reads twice as many.
FIRST_READ = 16
#: Positions looked at in one step when a best position moves on.
LOOK_AHEAD = 128

#: Weights in percent of the document length in the impact, and the factors of the integer formula.
LENGTH_SHARE, TF_SCALE, TF_FACTOR, LENGTH_FACTOR, IDF_SCALE = 75, 1_000_000_000, 1000, 8, 1000


def term_weight(n_docs: int, df: int) -> int:
    return floor(IDF_SCALE * log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Score that each (document, term) adds per occurrence of the term in a query."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n_docs // total
    return weight * (TF_SCALE * tf // (TF_FACTOR * tf + LENGTH_FACTOR * m))


class Block:
    """Impact lists and direct-access table of some documents, for terms numbered 0 to ``terms`` - 1."""

    def __init__(self, ids: list[int | None], doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        held = impact > 0
        doc, term, impact = doc[held], term[held], impact[held]
        order = np.lexsort((-impact, term))
        self.ids = ids
        self.docs, self.impact = doc[order].astype(np.intp), impact[order]
        ends = np.searchsorted(term[order], np.arange(terms + 1))
        self.start, self.end = ends[:-1], ends[1:]
        self.direct = np.zeros((terms, len(ids)), np.int64)
        self.direct[term, doc] = impact

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Add the block's documents that can be among the best; returns the number of documents met."""
        some = self.end[terms] > self.start[terms]
        terms, times = terms[some], times[some]
        start, end = self.start[terms], self.end[terms]
        if not len(terms):
            return 0
        seen = np.zeros(len(self.ids), bool)
        run = start.copy()  # one after the best position of each list
        read, depth = 0, FIRST_READ
        bound = int((times * self.impact[start]).sum())
        while bound and not (best.kth() is not None and bound < best.kth()):
            at = start[:, None] + np.arange(read, depth)
            met = np.unique(self.docs[at[at < end[:, None]]])
            met = met[~seen[met]]
            seen[met] = True
            score = times @ self.direct[np.ix_(terms, met)]
            if best.kth() is not None:
                reach = score >= best.kth()
                met, score = met[reach], score[reach]
            elif len(score) > best.k:
                reach = score >= np.partition(score, -best.k)[-best.k]
                met, score = met[reach], score[reach]
            if len(met):
                best.add(score.tolist(), [self.ids[i] for i in met])
            run = self._run(run, end, seen)
            last = np.where(run == end, 0, self.impact[np.maximum(run - 1, start)])  # a list seen whole holds no unmet document
            bound = int((times * last).sum())
            read, depth = depth, 2 * depth
        return int(seen.sum())

    def _run(self, run: np.ndarray, end: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Move every list's run over seen positions on."""
        run, moving = run.copy(), np.flatnonzero(run < end)
        while len(moving):
            at = run[moving, None] + np.arange(LOOK_AHEAD)
            gap = at >= end[moving, None]
            gap[~gap] = ~seen[self.docs[at[~gap]]]
            whole = ~gap.any(axis=1)
            run[moving] += np.where(whole, LOOK_AHEAD, gap.argmax(axis=1))
            moving = moving[whole & (run[moving] < end[moving])]
        return run


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms, times, n_terms) per row with at least one term; terms are UTF-8 bytes."""

    def count(texts):
        found = []
        for t in texts:
            once: dict[bytes, int] = {}
            for w in alnum_words(t or b""):
                once[w] = once.get(w, 0) + 1
            found.append(once)
        return {"terms": pa.array([list(o) for o in found], pa.list_(pa.binary())),
                "times": pa.array([list(o.values()) for o in found], pa.list_(pa.int64())),
                "n_terms": pa.array([len(o) for o in found], pa.int64())}

    plain = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    return map_text(plain, "text", count, "terms array<binary>, times array<bigint>, n_terms bigint", ["item_id"]).filter("n_terms > 0")


def postings(docs: DataFrame, id_col: str, text_col: str, known) -> DataFrame:
    """(id, length, codes, tfs) of every document with a term, for the terms of the broadcast ``known``
    ({term: code from 1}); codes ascend. Narrow, written once."""

    def count(texts):
        get, lengths, found = known.value.get, [], []
        for row, t in enumerate(texts):
            words = alnum_words(t or b"")
            lengths.append(len(words))
            codes = np.fromiter(filter(None, map(get, words)), np.int64)
            found.append(codes + (row << 32))
        keys, tfs = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1, len(texts)) << 32)
        codes = np.split(((keys & 0xFFFFFFFF) - 1).astype("<u4"), cuts)
        return {"length": pa.array(lengths, pa.int64()), "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
                "tfs": pa.array([c.tobytes() for c in np.split(tfs.astype("<u4"), cuts)], pa.binary())}

    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return freeze(map_text(plain, "text", count, "length bigint, codes binary, tfs binary", ["id"]).filter("length > 0"))


def _document_frequencies(table: DataFrame, terms: int) -> np.ndarray:
    """Documents per term; one row per term and task is shuffled, one per term reaches the driver."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            raw = b"".join(v for v in batch.column(0).to_pylist() if v)
            total += np.bincount(np.frombuffer(raw, "<u4"), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "n"])

    out = np.zeros(terms, np.int64)
    for r in table.select("codes").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _blocks(batches, weight: np.ndarray, n_docs: int, total: int) -> Iterator[Block]:
    """Blocks of equal numbers of documents from however large batches come."""
    held: list[list] = [[], [], [], []]
    docs = max(1, min(BLOCK_DOCS, BLOCK_CELLS // max(1, len(weight))))

    def block():
        ids, length, codes, tfs = held
        doc = np.repeat(np.arange(len(ids)), [len(c) // 4 for c in codes])
        term = np.frombuffer(b"".join(codes), "<u4").astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
        made = Block(ids, doc, term, impacts(weight[term], tf, np.array(length)[doc], n_docs, total), len(weight))
        held[:] = [[], [], [], []]
        return made

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, docs - len(held[0]))
            at += part.num_rows
            for h, c in zip(held, part.columns):
                h += c.to_pylist()
            if len(held[0]) == docs:
                yield block()
    if held[0]:
        yield block()


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", piece_terms: int = PIECE_TERMS) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` best documents of every item, those with score above 0.

    Terms are runs of ASCII letters and digits and of other characters outside ASCII, A-Z in lower
    case. Documents without a term (null texts too) are not counted and never found; repeated document
    rows are documents of their own. Equal scores are ranked by ascending id, null ids last. Each item
    row is asked by itself, also if ids repeat; one without terms gets no rows. Items are asked in
    pieces of bounded size, each a pass over the documents; a task hands on at most ``k`` rows per
    item and keeps its k-th best scores from block to block.
    """
    spark = docs.sparkSession
    asked, count = pieces(query_terms(items, item_id, item_text), "n_terms", piece_terms)
    folder = work_folder(spark, "ranked")
    for p in range(count):
        rows = asked.filter(F.col("piece") == p).select("number", "terms", "times").collect()
        code: dict[bytes, int] = {}
        for r in rows:
            for t in r["terms"]:
                code.setdefault(bytes(t), len(code) + 1)
        known = spark.sparkContext.broadcast(code)
        table = postings(docs, id_col, text_col, known)
        n_docs, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        weight = np.array([term_weight(n_docs, int(df)) for df in _document_frequencies(table, len(code))], np.int64)
        wanted = [(r["number"], np.array([code[bytes(t)] - 1 for t in r["terms"]]), np.array(r["times"], np.int64)) for r in rows]
        sent = spark.sparkContext.broadcast((weight, wanted))

        def run(batches, sent=sent, n_docs=n_docs, total=total):
            weight, wanted = sent.value
            best: dict[int, Best] = {}
            for block in _blocks(batches, weight, n_docs, total):
                for number, terms, times in wanted:
                    block.search(terms, times, best.setdefault(number, Best(k)))
            yield from best_rows(TaskContext.get().partitionId(), best)

        table.mapInArrow(run, BEST_SCHEMA).write.mode("append").parquet(folder)
        known.destroy()
        sent.destroy()
    if not count:
        spark.createDataFrame([], BEST_SCHEMA).write.parquet(folder)
    found = merge_top(spark.read.schema(BEST_SCHEMA).parquet(folder), "id", k)
    return found.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "id", "score")
