"""Token ids in fixed-width bit-packed shard files with random access.

File layout, little-endian, one shard per range of ids and at most about ``SHARD_TOKENS`` tokens:

    magic 8 bytes "TOKPACK1"; width in bits u4; tokens per block u4; n documents u8; n tokens u8;
    n blocks u8;
    document start (tokens, within the shard) u8 * (n documents + 1);
    document id i8 * n documents; document id present u1 * n documents;
    block offset (bytes, within the payload) u8 * (n blocks + 1);
    payload: every block of ids packed with ``width`` bits each, lowest bit first, padded to a byte;
    with magic "TOKPACK2" only: position of each document in the training stream i8 * n documents.

A block is unpacked with a few numpy operations; a document is read by unpacking the blocks that its
start and end fall into.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.files import open_folder, output_folder, put, read_files
from rasterloom.llm.ranges import range_ends, range_part
from rasterloom.llm.text import map_text
from rasterloom.runtime import freeze, shuffle_width

#: Without and with positions.
MAGIC, MAGIC_ORDER = b"TOKPACK1", b"TOKPACK2"
BLOCK = 4096
SHARD_TOKENS = 4 << 20
#: Id ranges per output partition, so that hashed ranges fill the partitions evenly.
RANGES = 4
#: Distinct pieces whose ids a worker process remembers.
REMEMBERED = 800_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, width: int) -> bytes:
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(raw, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_shard(ids: list[int | None], documents: list[np.ndarray], width: int, block: int = BLOCK,
                 positions: list[int] | None = None) -> bytes:
    starts = np.zeros(len(documents) + 1, "<u8")
    np.cumsum([len(d) for d in documents], out=starts[1:])
    tokens = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    if len(tokens) and int(tokens.max()) >> width:
        raise ValueError("a token id does not fit the width")
    if width in (8, 16, 32):  # whole bytes: the same bits without unfolding them
        whole = tokens.astype(f"<u{width // 8}").tobytes()
        step = block * width // 8
        blocks = [whole[s:s + step] for s in range(0, len(whole), step)]
    else:
        blocks = [pack_block(tokens[s:s + block], width) for s in range(0, len(tokens), block)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    return b"".join([
        MAGIC if positions is None else MAGIC_ORDER, np.array([width, block], "<u4").tobytes(),
        np.array([len(documents), len(tokens), len(blocks)], "<u8").tobytes(), starts.tobytes(),
        np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], "u1").tobytes(),
        offsets.tobytes(), *blocks, b"" if positions is None else np.array(positions, "<i8").tobytes()])


class Shard:
    """Random access to one shard held as bytes (or a memory map)."""

    def __init__(self, raw):
        if bytes(raw[:8]) not in (MAGIC, MAGIC_ORDER):
            raise ValueError("not a packed token file")
        self.width, self.block = (int(x) for x in np.frombuffer(raw, "<u4", 2, 8))
        self.n, self.n_tokens, blocks = (int(x) for x in np.frombuffer(raw, "<u8", 3, 16))
        at = 40
        self.starts = np.frombuffer(raw, "<u8", self.n + 1, at).astype(np.int64)
        at += 8 * (self.n + 1)
        self.ids = np.frombuffer(raw, "<i8", self.n, at)
        at += 8 * self.n
        self.present = np.frombuffer(raw, "u1", self.n, at).astype(bool)
        at += self.n
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(raw)[at + 8 * (blocks + 1):]
        ordered = bytes(raw[:8]) == MAGIC_ORDER
        self.positions = np.frombuffer(self.payload, "<i8", self.n, int(self.offsets[-1])) if ordered else None

    def _blocks(self, first: int, last: int) -> np.ndarray:
        return np.concatenate([
            unpack_block(self.payload[self.offsets[b]:self.offsets[b + 1]],
                         min(self.block, self.n_tokens - b * self.block), self.width) for b in range(first, last)])

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        if a == b:
            return np.zeros(0, np.uint32)
        first = a // self.block
        return self._blocks(first, -(-b // self.block))[a - first * self.block:b - first * self.block]


#: Letters below U+0250: composed, each with a lower case of its own. Words of them, ASCII digits and
#: ASCII marks are cut here as the pre-tokenizer cuts them.
_LETTERS = "a-zA-Z" + "".join(chr(c) for c in range(0x80, 0x250) if chr(c).isalpha())
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+")
#: Between one of these letters or digits and one of these marks the pre-tokenizer always cuts.
_CLOSING = r"([a-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?])"
_ATOM = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: Per worker process and tokenizer file: the tokenizer and the ids of the words met so far.
_MET: dict[str, _Words] = {}


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary; the space stays, to part words."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)} | {0x20: " "}


class _Words:
    """Ids of single words from the library, remembered in one array: ``known`` gives a word's row in
    ``start`` and ``size``, which point into ``tokens``.

    A plain word is cut into letters, digits and marks, and such atoms are encoded by the file's BPE
    model many at a time, parted by spaces, and told apart by the tokens that end an atom. That holds
    only if each atom has one such token; since none has fewer, equal numbers prove it. Other words go
    one by one through the whole tokenizer.
    """

    def __init__(self, path: str, together: int = 1024):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would spin
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole, self.tok, self.together = Tokenizer.from_file(path), Tokenizer.from_file(path), together
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.literals = [t["content"].encode() for t in stated["added_tokens"]]
        vocabulary = self.tok.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        model = stated["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.model, self.letters = None, _byte_letters()
        if model.get("type") == "BPE" and suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.model = Tokenizer(models.BPE(model["vocab"], merges, end_of_word_suffix=suffix, cache_capacity=0))  # words come once
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of words whose ASCII letters are in lower case."""
        get = self.known.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        gaps = np.flatnonzero(found < 0)
        if len(gaps):
            new = [words[i] for i in gaps.tolist()]
            self._learn(new)
            found[gaps] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return found

    def _put(self, words: list[str], sizes: list[np.ndarray], parts: list[np.ndarray]) -> None:
        """Remember words, whose ids stand one after the other in ``parts``."""
        size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.start = np.concatenate((self.start, len(self.tokens) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.tokens = np.concatenate((self.tokens, *parts)).astype(self.kind)

    def _one_by_one(self, words: list[str]) -> None:
        for s in range(0, len(words), 8192):
            found = [e.ids for e in self.tok.encode_batch_fast(words[s:s + 8192], add_special_tokens=False)]
            self._put(words[s:s + 8192], [np.array([len(f) for f in found])], [np.array(f, self.kind) for f in found])

    def _learn(self, new: list[str]) -> None:
        rest, joined, missing = [], [], set()
        for w in new:
            if self.model is None or not w or not _PLAIN.fullmatch(w):  # '' stands beside white space at a text's ends
                rest.append(w)
            elif w.isalpha() and w.isascii():  # one atom, itself
                missing.add(w)
            else:
                parts = _ATOM.findall(w.lower())
                if parts != [w]:
                    joined.append((w, parts))
                missing.update(parts)
        atoms = sorted(a for a in missing if a not in self.known)  # neighbours share merges, which then stay in the cache
        words, sizes, found = [], [], []
        for s in range(0, len(atoms), self.together):
            group = atoms[s:s + self.together]
            ids = np.array(self.model.encode(" ".join(group).encode().decode("latin-1").translate(self.letters), add_special_tokens=False).ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                words += group
                sizes.append(np.diff(stops, prepend=0))
                found.append(ids)
            else:
                rest += group
        self._put(words, sizes, found)
        self._one_by_one(rest)
        if joined:
            rows = [[self.known[p] for p in parts] for _, parts in joined]
            flat = np.array([r for each in rows for r in each])
            size, ends = self.size[flat], np.cumsum([len(each) for each in rows])
            total = np.diff(np.cumsum(size)[ends - 1], prepend=0)
            self._put([w for w, _ in joined], [total], [self.ids(flat)])

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of words one after the other."""
        size = self.size[rows]
        return self.tokens[np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def library_encoder(path: str, end: int) -> Callable[[list[bytes | None]], list[np.ndarray]]:
    """Encode texts as the library's plain call does, with a lower-casing BPE file whose pre-tokenizer
    drops white space and parts letters, single digits, runs of marks and English contractions.

    Words between ASCII white space are encoded once and remembered by the worker process, which
    gives the ids of the whole text. A text that holds an added token of the file literally (such as
    an end mark) is encoded whole. ``end`` closes each document. Ids come as 16-bit numbers if all of
    the file's fit.
    """

    def run(texts):
        if path not in _MET:
            _MET[path] = _Words(path)
        words = _MET[path]
        if len(words.known) > REMEMBERED:
            words.forget()
        marked = {i for i, t in enumerate(texts) if t and any(mark in t for mark in words.literals)}
        plain = pa.array([b"" if t is None or i in marked else t for i, t in enumerate(texts)], pa.binary()).cast(pa.string())
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), _CLOSING, r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        rows = words.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        stream = words.ids(rows)
        stops = np.concatenate(([0], np.cumsum(words.size[rows])))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        close = np.array([end], words.kind)
        out = [np.concatenate((stream[a:b], close)) for a, b in zip(stops[:-1], stops[1:])]
        for i in marked:
            out[i] = np.array([*words.whole.encode(texts[i].decode(), add_special_tokens=False).ids, end], words.kind)
        return out

    return run


def write_tokens(docs: DataFrame, encode, vocabulary: int, id_col: str = "doc_id", text_col: str = "text",
                 folder: str | None = None, order_col: str | None = None) -> tuple[str, DataFrame]:
    """Write the ids of all texts in ascending id order; (folder, manifest of shards).

    ``encode`` maps texts (bytes, null kept) to id arrays. Rows are dealt by ranges of ids whose ends
    are known beforehand (a range exchange would sample, and so encode, twice), so that a shard holds
    neighbouring ids; equal ids are ordered by text, null ids come first. A null
    text is encoded as the empty text. With ``order_col`` (a number, not null) each document's position
    in the training stream is stored beside it; equal rows follow it. Shards are named by partition and number, so a retried task
    replaces its own files. The manifest has (shard, part, seq, n_docs, n_tokens, start), where start
    counts the tokens of all shards before.
    """
    spark = docs.sparkSession
    folder = folder or output_folder(spark, "tokens")
    open_folder(folder)  # also there when no task has a row
    width = bits_for(vocabulary)
    kind = "<u2" if width <= 16 else "<u4"  # how ids travel to their shard
    order = [F.col(order_col).cast("bigint").alias("position")] if order_col else []
    kept = ["position"] if order_col else []
    encoded = map_text(
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *order), "text",
        lambda texts: {"tokens": pa.array([narrow(a, kind).tobytes() for a in encode(texts)], pa.binary()),
                       "text_hash": pa.array([zlib.crc32(t or b"") for t in texts], pa.int64())},
        "tokens binary, text_hash bigint", ["id", *kept])
    width_out = shuffle_width(spark)
    ends = range_ends(docs.select(F.col(id_col).cast("bigint").alias("id")), "id", RANGES * width_out)
    placed = encoded.withColumn("part", range_part(F.col("id"), ends))
    ordered = placed.repartition(width_out, "part").sortWithinPartitions("part", "id", "text_hash", "tokens", *kept)

    def run(batches):
        found, path = open_folder(folder)
        part, seq, ids, held, at, count = None, 0, [], [], [], 0

        def close():
            name = f"shard-{part:06d}-{seq:05d}.tok"
            put(found, path, name, encode_shard(ids, held, width, positions=at if order_col else None))
            return pa.RecordBatch.from_pydict({"shard": [name], "part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [count]})

        for b in batches:
            for i, tokens, p, *position in zip(*(c.to_pylist() for c in b.columns)):
                if ids and (p != part or count >= SHARD_TOKENS):
                    yield close()
                    seq = seq + 1 if p == part else 0
                    ids, held, at, count = [], [], [], 0
                part = p
                ids.append(i)
                at += position
                held.append(np.frombuffer(tokens, kind).astype("<u4"))
                count += len(held[-1])
        if ids:
            yield close()

    manifest = freeze(ordered.select("id", "tokens", "part", *kept).mapInArrow(
        run, "shard string, part bigint, seq bigint, n_docs bigint, n_tokens bigint"))
    return folder, _starts(manifest)


def narrow(ids: np.ndarray, kind: str) -> np.ndarray:
    if ids.dtype == kind:
        return ids
    if len(ids) and int(ids.max()) > np.iinfo(kind).max:
        raise ValueError("a token id does not fit the vocabulary")
    return ids.astype(kind)


def _starts(manifest: DataFrame) -> DataFrame:
    """Tokens before each shard: first by range (one row per range), then inside the range."""
    by_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = by_part.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("range_start"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ranges, "part").select(
        "shard", "part", "seq", "n_docs", "n_tokens", (F.col("range_start") + F.col("within")).alias("start"))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False,
                with_position: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids][, position]) per document, from the files alone but for the
    shards' starts; a shard is unpacked document by document through its block offsets. The training
    stream is the documents by position (null in files written without)."""
    schema = ("id bigint, n_tokens bigint, within bigint, ids_crc32 bigint, shard string"
              + (", ids array<int>" if with_ids else "") + (", position bigint" if with_position else ""))

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(raw.as_buffer())
                for s in range(0, shard.n, 4096):
                    rows = range(s, min(shard.n, s + 4096))
                    docs = [shard.document(i).astype("<u4") for i in rows]
                    out = {
                        "id": pa.array([int(shard.ids[i]) if shard.present[i] else None for i in rows], pa.int64()),
                        "n_tokens": pa.array([len(d) for d in docs], pa.int64()),
                        "within": pa.array([int(shard.starts[i]) for i in rows], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                        "shard": pa.array([path.rsplit("/", 1)[-1]] * len(docs)),
                    }
                    if with_ids:
                        out["ids"] = pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32()))
                    if with_position:
                        out["position"] = pa.array([None if shard.positions is None else int(shard.positions[i]) for i in rows], pa.int64())
                    yield pa.RecordBatch.from_pydict(out)

    rows = read_files(spark, folder, "shard-*.tok").mapInArrow(run, schema)
    return (
        rows.join(freeze(manifest.select("shard", F.col("start").alias("shard_start"))), "shard")
        .select("id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32",
                *(["ids"] if with_ids else []), *(["position"] if with_position else [])))


def stream_positions(docs: DataFrame, columns: list[str]) -> DataFrame | None:
    """``columns`` and ``position``, the place of each row in a table that Spark wrote as Parquet from an
    ordered frame: 0, 1, ... by number of the written part and row inside it.

    File and row stay with a row through filters and exchanges, but not through another write. None
    for a frame that is not read from files: it has no such order.
    """
    own = [F.col(f"`{c}`") for c in columns]
    try:
        source = docs.metadataColumn("_metadata")  # also where a column has that name
        rows = docs.select(*own, source["file_path"].alias("_file"), source["file_name"].alias("_name"), source["row_index"].alias("_row"))
    except AnalysisException:
        return None
    files = rows.groupBy("_file", "_name").agg((F.max("_row") + 1).alias("n"))
    part = F.regexp_extract("_name", r"^part-(\d+)", 1).try_cast("bigint")
    before = W.orderBy(part, "_file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    starts = freeze(files.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    return rows.join(starts, "_file").select(*own, (F.col("_start") + F.col("_row")).alias("position"))
