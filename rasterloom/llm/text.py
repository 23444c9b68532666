"""Words of Arrow text columns, read as UTF-8 bytes, and the loop that maps a batch of rows.

Lower-casing touches A-Z only. ``plain_words`` are runs of anything but ASCII white space;
``alnum_words`` are runs of digits, letters and non-ASCII characters. Both work on bytes: all
separators are single ASCII bytes, so a character is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes handled at once inside a batch; a longer text is handled on its own.
STEP_BYTES = 2 << 20

#: Rows per Arrow batch at most: documents are long, and a batch exists in the JVM and in Python.
BATCH_ROWS = 1000

_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(_ALNUM).split()


def steps(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batch that end with the row in which a multiple of ``STEP_BYTES`` of text is
    passed, and their texts. ``column`` may name a field of a struct column (``row.text``).

    Only a slice's texts become Python objects; the memory of finished slices is given back.
    """
    name, *fields = column.split(".")
    texts = batch.column(batch.schema.get_field_index(name))
    for field in fields:
        texts = pc.struct_field(texts, field)
    texts = texts.cast(pa.binary())
    passed = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // STEP_BYTES
    ends = np.flatnonzero(np.diff(passed)) + 1 if len(passed) else []
    for start, end in zip([0, *ends], [*ends, len(texts)]):
        if start < end:
            yield batch.slice(start, end - start), texts.slice(start, end - start).to_pylist()
    give_back()


def give_back() -> None:
    """Return freed memory to the system; workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` where it is larger; the frame is returned."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def map_text(df: DataFrame, column: str, fn: Callable[[list[bytes | None]], dict[str, pa.Array]], schema: str,
             keep: list[str]) -> DataFrame:
    """Add columns computed from a text column (or struct field); of the input only ``keep`` stays, in
    this order.

    ``schema`` is the DDL of the added columns in the order in which ``fn`` returns them.
    """
    inside = column.partition(".")[0] in keep  # a field of a struct that is kept anyway
    source = df.select(*dict.fromkeys(keep if inside else [*keep, column]))
    out = StructType([source.schema[c] for c in keep] + StructType.fromDDL(schema).fields)  # names as they are, nested ones too

    def run(batches):
        for batch in batches:
            for part, texts in steps(batch, column):
                added = fn(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(k)) for k in keep] + list(added.values()),
                    names=[*keep, *added])

    return small_batches(source).mapInArrow(run, out)


def coded(word_lists: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of every word in row order, the distinct words by code, row offsets)."""
    offsets = np.zeros(len(word_lists) + 1, np.int64)
    np.cumsum([len(w) for w in word_lists], out=offsets[1:])
    table = pa.array([w for ws in word_lists for w in ws], pa.binary()).dictionary_encode()
    return table.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.dictionary.to_pylist(), offsets


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(word_lists: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of each row, ascending; row offsets).

    A row with fewer than ``size`` words, but at least one, has its whole sequence as its only
    shingle; a row without words has none.
    """
    codes, words, offsets = coded(word_lists)
    lengths = np.diff(offsets)
    by_word = mix64(word_hashes(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(lengths)), n)
    first = offsets[:-1][rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n))
    width = np.minimum(lengths, size)[rows]
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64) * (width.astype(np.uint64) + np.uint64(1))
    for k in range(size):
        inside = width > k
        h[inside] = mix64(h[inside] * np.uint64(3) + by_word[first[inside] + k])
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    counts = np.bincount(rows[new], minlength=len(lengths))
    return h[new], np.concatenate(([0], np.cumsum(counts)))


def binaries(values: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous array as fixed-width binary values."""
    raw = np.ascontiguousarray(values)
    return pa.array([raw[i].tobytes()[:width] for i in range(len(raw))], pa.binary())


def digest128(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit digest per row of its ascending hashes."""
    view = memoryview(np.ascontiguousarray(h)).cast("B")
    return [xxhash.xxh3_128_digest(view[8 * a:8 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
