"""Benchmark passages in documents by Wu-Manber search over words.

A window is ``size`` consecutive words of an item (an item with fewer words is one shorter window).
Windows of one length form a pattern set. For a set of length m, the shift table tells for every
block of two words how far the search may jump: m - 1 when the block is in no window, else the
distance of its last place from the window's end. At shift 0 the block's bucket gives the windows
that end in it, which are compared word by word.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import alnum_words, map_text

#: Words of the items that one table may hold; more items are searched table after table.
TABLE_WORDS = 2_000_000


class PatternSet:
    """The windows of one length with their items."""

    def __init__(self, size: int, windows: dict[tuple, list]):
        self.size, self.windows = size, windows
        self.width = min(2, size)
        self.far = size - self.width + 1
        self.shift: dict = {}
        self.ends: dict = {}
        for w in windows:
            for k in range(self.width, size + 1):
                block = w[k - self.width:k]
                self.shift[block] = min(self.shift.get(block, self.far), size - k)
            self.ends.setdefault(w[size - self.width:], []).append(w)

    def search(self, codes: list[int], found) -> None:
        """Call ``found(start, window)`` for every place of a window in the coded words."""
        size, width, far, shift, ends = self.size, self.width, self.far, self.shift, self.ends
        at, n = size, len(codes)
        get = shift.get
        if width == 1:
            for i, c in enumerate(codes):
                if (c,) in ends:
                    found(i, (c,))
            return
        while at <= n:
            jump = get((codes[at - 2], codes[at - 1]), far)
            if jump:
                at += jump
                continue
            here = tuple(codes[at - size:at])
            for w in ends[here[size - width:]]:
                if w == here:
                    found(at - size, w)
            at += 1


class Table:
    """All windows of a set of items, by length, over a small word code; 0 is any other word."""

    def __init__(self, items: list[tuple], size: int):
        self.code: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, list]] = {}
        for item, text in items:
            words = alnum_words((text or "").encode())
            coded = [self.code.setdefault(w, len(self.code) + 1) for w in words]
            n = min(size, len(coded))
            for i in range(len(coded) - n + 1 if n else 0):
                owners = by_length.setdefault(n, {}).setdefault(tuple(coded[i:i + n]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.sets = [PatternSet(n, w) for n, w in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(start, end) of every occurrence and the items they belong to."""
        get = self.code.get
        codes = [get(w, 0) for w in words]
        spans, items = [], set()
        for s in self.sets:
            def found(start, window, s=s):
                spans.append((start, start + s.size))
                items.update(s.windows[window])
            s.search(codes, found)
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside the union of the spans."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _tables(items: DataFrame, item_col: str, text_col: str, size: int, table_words: int) -> list:
    """Broadcast tables; each holds the items of one residue of the item's hash, so the driver and a
    task hold one table of bounded size at a time, however many items there are."""
    spark = items.sparkSession
    chosen = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = chosen.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = max(1, math.ceil(total / table_words))
    out = []
    for k in range(parts):
        some = chosen.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()
        if some:
            out.append(spark.sparkContext.broadcast(Table([(r["item"], r["text"]) for r in some], size)))
            some = None
    return out


def scan(docs: DataFrame, items: DataFrame, text_col: str, keep: list[str], item_col: str = "item_id",
         item_text: str = "text", size: int = 10, table_words: int = TABLE_WORDS) -> DataFrame:
    """``keep`` and (n_words, n_hit, n_items, items_sha256, spans), one row per input row.

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. ``spans`` are the
    (start, end) word intervals of the merged occurrences, ``n_hit`` the words inside them, ``n_items``
    the items with an occurring window, ``items_sha256`` the SHA-256 of their ids, sorted as strings
    and joined by commas. Null texts have no words, items without words no windows; a null item id
    counts as the id ''. Items with the same id are one item. Without items nothing is hit.
    """
    tables = _tables(items, item_col, item_text, size, table_words)

    def run(texts):
        words = [alnum_words(t or b"") for t in texts]
        spans, found = [[] for _ in texts], [set() for _ in texts]
        for t in tables:
            table = t.value
            for i, w in enumerate(words):
                s, x = table.hits(w)
                spans[i] += s
                found[i] |= {v or "" for v in x}
        merged = [_merge(s) for s in spans]
        return {
            "n_words": pa.array(map(len, words), pa.int64()),
            "n_hit": pa.array([covered(s) for s in merged], pa.int64()),
            "n_items": pa.array(map(len, found), pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]),
            "spans": pa.array([[{"start": a, "end": b} for a, b in m] for m in merged],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }

    return map_text(docs, text_col, run, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
                    "spans array<struct<start: bigint, end: bigint>>", keep)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
