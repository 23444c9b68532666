"""I-Match fingerprints: digests of the document's terms from a lexicon of medium document frequency.

The lexicon holds the terms whose share of documents lies in a band. A document's distinct lexicon
terms, sorted, are hashed once as they are and once for each of several randomised sub-lexicons; a
sub-lexicon keeps a term when the term's draw for it falls below its rate. Dense sub-lexicons tell near
copies, sparse ones still agree for documents that share a part of their terms.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.ranges import range_ends, range_part
from rasterloom.llm.text import alnum_words, coded, mix64, small_batches, steps, word_hashes
from rasterloom.runtime import shuffle_width

#: Band of the share of documents that a lexicon term occurs in. At most (mean distinct terms of a
#: document / LOW) terms can reach LOW, whatever the corpus: this bounds the broadcast lexicon.
LOW, HIGH = 0.0005, 0.2
#: Share of the lexicon kept by each randomised sub-lexicon, and how many sub-lexicons have it.
RATES = ((0.7, 2), (0.3, 2), (0.1, 4), (0.03, 8), (0.01, 24), (0.005, 32), (0.0025, 24))
#: Id ranges per output partition of the neighbour pass.
RANGES = 4


def _sub_lexicons() -> list[float]:
    return [1.0, *(r for r, n in RATES for _ in range(n))]


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n): the number of rows in which a term's 64-bit hash occurs, summed in the task first."""

    def run(batches):
        for b in batches:
            for _, texts in steps(b, text_col):
                codes, distinct, offsets = coded([alnum_words(t or b"") for t in texts])
                rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
                pairs = np.unique(rows * max(1, len(distinct)) + codes)
                n = np.bincount(pairs % max(1, len(distinct)), minlength=len(distinct))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word_hashes(distinct).view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])

    return small_batches(docs.select(text_col)).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the band's terms; bounded as stated at ``LOW``."""
    total = docs.count()
    band = document_frequencies(docs, text_col).filter((F.col("n") >= low * total) & (F.col("n") <= high * total))
    terms = band.select("term").toArrow().column(0).to_numpy().view(np.uint64)
    return np.sort(terms)


def signatures(texts: list[bytes], lex: np.ndarray) -> np.ndarray:
    """(rows, lexicons) digests, of 64 bits for the whole lexicon and 16 for the others; 0 where a row has
    no term of a sub-lexicon.

    A row without any lexicon term is fingerprinted by all its terms, one without terms by its bytes.
    """
    rates = _sub_lexicons()
    codes, distinct, offsets = coded([alnum_words(t) for t in texts])
    out = np.zeros((len(texts), len(rates)), np.uint64)
    hashes = word_hashes(distinct)
    if len(distinct):
        at = np.minimum(np.searchsorted(lex, hashes), max(0, len(lex) - 1))
        listed = lex[at] == hashes if len(lex) else np.zeros(len(hashes), bool)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        has = np.zeros(len(texts), bool)
        has[rows[listed[codes]]] = True
        use = listed[codes] | ~has[rows]
        rank = np.empty(len(hashes), np.int64)
        by_hash = np.argsort(hashes)
        rank[by_hash] = np.arange(len(hashes))
        pairs = np.unique(rows[use] * len(hashes) + rank[codes[use]])
        r, term = pairs // len(hashes), pairs % len(hashes)
        ordered = hashes[by_hash]
        for k, rate in enumerate(rates):
            salt = np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
            kept = slice(None) if rate >= 1 else (mix64(ordered + salt) < np.uint64(int(rate * 2.0**64)))[term]
            _digest_rows(ordered[term[kept]], r[kept], out[:, k])
    out[:, 1:] >>= np.uint64(48)
    for i in np.flatnonzero(out[:, 0] == 0):
        out[i, 0] = xxhash.xxh3_64_intdigest(texts[i]) | 1
    return out


def _digest_rows(h: np.ndarray, r: np.ndarray, out: np.ndarray) -> None:
    """Digest of each row's ascending hashes: a position-dependent sum, scrambled."""
    if not len(h):
        return
    starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    terms = mix64(h + mix64(place.astype(np.uint64) + np.uint64(1)))
    out[r[starts]] = mix64(np.add.reduceat(terms, starts) + np.uint64(1)) | np.uint64(1 | 1 << 48)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing digests among the sub-lexicons in which either side has terms, row by row."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    return (((a == b) & (a != 0)).sum(axis=1) / np.maximum(either, 1)).round(6)


def as_text(sig: np.ndarray) -> list[str]:
    return [row[:1].astype(">u8").tobytes().hex() + row[1:].astype(">u2").tobytes().hex() for row in sig]


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, id, row_hash, text, ghost) sorted by part and descending id, each range of ids followed by a copy of
    the row that comes next, the first row of the next lower range; the lowest range is followed by
    the first row of all.

    Equal ids follow each other by text hash, null ids come last. One exchange of the texts; the range
    ends and each range's first row come from ids and hashes alone.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("row_hash"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = range_ends(rows.select("id"), "id", RANGES * width)
    placed = rows.withColumn("part", range_part(F.col("id"), ends))
    first = placed.groupBy("part").agg(F.min(F.struct((-F.col("id")).alias("down"), "row_hash")).alias("k"))
    heads = sorted(((r["part"], r["k"]["down"], r["k"]["row_hash"]) for r in first.collect()), reverse=True)
    if not heads:
        return placed.select("part", "id", "row_hash", "text", F.lit(0).alias("ghost"))
    # the head of each range is also the successor of the range above; the highest head follows the lowest range
    goes_to = {head[1:]: heads[k - 1][0] for k, head in enumerate(heads)}
    key = F.concat_ws(":", F.coalesce((-F.col("id")).cast("string"), F.lit("")), F.col("row_hash").cast("string"))
    table = F.create_map(*[F.lit(v) for (down, h), p in goes_to.items() for v in (f"{'' if down is None else down}:{h}", p)])
    copies = F.when(table[key].isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(0).alias("ghost")), F.struct(table[key].alias("part"), F.lit(1).alias("ghost"))))
    return (
        placed.withColumn("copy", F.explode(copies))
        .select("copy.part", "id", "row_hash", "text", "copy.ghost")
        .repartition(width, "part").sortWithinPartitions("part", "ghost", F.desc("id"), "row_hash"))


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down, in code points) gives way to as many of the next one's first."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    ``fingerprint`` is the hex of the digests of all sub-lexicons. A null text is an empty one. The
    next document is the one with the next smaller id (equal ids: by text hash; null ids last), after
    the last one the first; a single document follows itself. Equal texts have equal fingerprints.
    """
    spark = docs.sparkSession
    lex = spark.sparkContext.broadcast(lexicon(docs, text_col))

    def flush(held):
        """Rows that have their successor: consecutive rows of one range."""
        texts = [h[1] for h in held]
        edits = [edited(a, b) for a, b in zip(texts, texts[1:])]
        raw = [t.encode() for t in texts]
        raw_edits = [e.encode() for e in edits]
        own = signatures(raw, lex.value)
        other = signatures(raw_edits, lex.value)
        return pa.RecordBatch.from_pydict({
            "id": pa.array([h[0] for h in held[:-1]], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in raw_edits],
            "fingerprint": as_text(own[:-1]), "edited_fingerprint": as_text(other),
            "near_edited": likeness(own[:-1], other), "near_next": likeness(own[:-1], own[1:])})

    def run(batches):
        held, size, part, ghosted = [], 0, None, False
        for b in batches:
            for p, i, text, ghost in zip(*(b.column(k).to_pylist() for k in range(4))):
                if p != part:
                    if len(held) > 1:
                        yield flush(held)
                    held, size, part, ghosted = [], 0, p, False
                if ghosted:  # equal heads: the first copy is the successor
                    continue
                ghosted = bool(ghost)
                held.append((i, text))
                size += len(text)
                if size > 1 << 20 and len(held) > 1:
                    yield flush(held)
                    held, size = held[-1:], len(text)
        if len(held) > 1:
            yield flush(held)

    return small_batches(neighbours(docs, id_col, text_col).select("part", "id", "text", "ghost")).mapInArrow(
        run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
