"""Near-duplicate documents: universal hash minima, banding, exact confirmation, components.

1. Every document gets its distinct word shingles, a digest of that set (its class) and, per band,
   a hash of a few minima of universal hash functions. Documents of one class are copies; from here
   on a class is one row.
2. Classes that agree in a band share a bucket. Buckets are linked to their smallest class and
   collapsed into candidate clusters by components, so that most texts are shipped once.
3. A cluster that fits into one block is one group. A larger one is taken bucket by bucket, and a
   bucket beyond a block is cut into blocks which meet pairwise; nothing is capped.
4. Inside a group, pairs that are not yet connected are compared by signature, then confirmed on
   their full shingle sets; only the edges of a spanning forest leave the task.
5. Components of the confirmed edges give the component of every class, and with it of every row.

The number of bands follows from the threshold: a link at the threshold is missed with a probability
of at most ``MISS``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.components import connected_components, join_hot
from rasterloom.llm.text import digest128, map_text, mix64, plain_words, shingles, whole_row
from rasterloom.runtime import freeze

#: Minima per band, and the chance of missing a link that lies at the threshold.
ROWS, MISS = 4, 1e-9
#: Shingles of the members of one block.
BLOCK_SHINGLES = 400_000
#: Rows up to which a list of wanted documents is broadcast (about 100 bytes a row).
BROADCAST_ROWS = 300_000
#: At most so many classes can hold that share of all rows; they are joined by broadcast.
HOT_CLASSES = 1000
#: Standard deviations by which an estimate may fall below the threshold before a pair is ruled out.
SLACK = 6.0
#: Survivors among a block's pairs above which intersections are counted by a matrix product.
DENSE = 500


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` universal hash functions, from a counter."""
    i = np.arange(1, n + 1, dtype=np.uint64)
    return mix64(i * np.uint64(2) + np.uint64(1)) | np.uint64(1), mix64(i * np.uint64(2))


def minima(h: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) minima of multiply-shift hashes as 32-bit numbers; rows without shingles hold 0."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, n), np.uint32)
    if len(full):
        a, b = _coefficients(n)
        starts = offsets[:-1][full]
        for k in range(n):
            out[full, k] = np.minimum.reduceat(((h * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _signer(size: int, bands: int):
    def run(texts):
        h, offsets = shingles([plain_words(t or b"") for t in texts], size)
        n = np.diff(offsets)
        m = minima(h, offsets, bands * ROWS).reshape(len(texts), bands, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), m.shape[:2]).copy()
        for k in range(ROWS):
            key = mix64(key * np.uint64(5) + m[:, :, k])
        cls = [d if k else None for d, k in zip(digest128(h, offsets), n)]
        flat = pa.array(np.ascontiguousarray(key).view(np.int64).ravel())
        return {
            "n_shingles": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), flat),
        }

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _shared(h: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left row with every right row, by a blocked product of
    0/1 matrices over the shingles (32-bit floats are exact below 2**24 per slice)."""
    _, code = np.unique(h, return_inverse=True)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place_l, place_r = np.full(len(offsets) - 1, -1), np.full(len(offsets) - 1, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)))
    order = np.argsort(code, kind="stable")
    code, rows = code[order], rows[order]
    width = 2048
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (start, start + width))
        c, r = code[a:b] - start, rows[a:b]
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        at = place_l[r] >= 0
        x[place_l[r[at]], c[at]] = 1
        at = place_r[r] >= 0
        y[place_r[r[at]], c[at]] = 1
        both += x @ y.T
    return both


def confirmed_edges(h: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int,
                    bands: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between left and right rows (the same rows or
    disjoint ones)."""
    n = np.diff(offsets)
    forest = _Forest(len(n))
    sign = minima(h, offsets, bands * ROWS)
    t = percent / 100
    least = t - SLACK * math.sqrt(t * (1 - t) / sign.shape[1])
    one_side = left is right
    kept = []
    for i, row in enumerate(left):
        near = (sign[right] == sign[row]).mean(axis=1) >= least
        small, large = np.minimum(n[right], n[row]), np.maximum(n[right], n[row])
        near &= 100 * small >= percent * large
        if one_side:
            near[:i + 1] = False
        kept.append(np.flatnonzero(near))
    edges = []
    dense = _shared(h, offsets, left, right) if sum(map(len, kept)) > DENSE else None
    for i, row in enumerate(left):
        for j in kept[i]:
            other = right[j]
            if forest.root(int(row)) == forest.root(int(other)):
                continue
            if dense is not None:
                both = int(dense[i, j])
            else:
                both = len(np.intersect1d(h[offsets[row]:offsets[row + 1]], h[offsets[other]:offsets[other + 1]], True))
            if 100 * both >= percent * (int(n[row]) + int(n[other]) - both) and forest.join(int(row), int(other)):
                edges.append((int(row), int(other)))
    return edges


def _group_edges(size: int, percent: int, bands: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        pdf = pdf.drop_duplicates("cls").sort_values("cls", ignore_index=True)
        h, offsets = shingles([plain_words(t) for t in pdf["text"]], size)
        side = pdf["side"].to_numpy()
        every = np.arange(len(pdf))
        left, right = (every, every) if i == j else (every[side == i], every[side == j])
        edges = confirmed_edges(h, offsets, left, right, percent, bands)
        cls = pdf["cls"].tolist()
        return pd.DataFrame({"a": [cls[x] for x, _ in edges], "b": [cls[y] for _, y in edges]}, columns=["a", "b"])

    return run


def _candidates(classes: DataFrame) -> DataFrame:
    """(cls, hub, key) for every class that shares a band bucket with another one; the hub is the
    bucket's smallest class."""
    rows = classes.select("cls", F.explode("bands").alias("key"))
    shared = freeze(
        rows.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("members"))
        .filter("hub != last").select("key", "hub", "members"))
    return freeze(join_hot(rows, shared, "key", shared.agg(F.sum("members")).first()[0] or 0))


def _groups(classes: DataFrame, block: int) -> DataFrame:
    """(grp, i, j, side, cls, id, row_hash): the classes of every group, block pair by block pair."""
    found = _candidates(classes)
    cluster = connected_components(found.select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    member = freeze(cluster.join(classes.select("cls", "n", "id", "row_hash"), F.col("node") == F.col("cls")))
    weight = freeze(member.groupBy("root").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("members")))
    sized = join_hot(member, weight, "root", member.count())
    whole = sized.filter(F.col("weight") <= block).select(
        F.col("root").alias("grp"), F.lit(0).alias("side"), F.lit(1).alias("blocks"), "cls", "id", "row_hash")
    # the buckets of larger clusters; of buckets with the same members one is kept
    large = freeze(
        found.select("key", "cls").join(sized.filter(F.col("weight") > block), "cls")
        .select("key", "cls", "n", "id", "row_hash"))
    buckets = freeze(
        large.groupBy("key").agg(F.sum("n").alias("weight"), F.count("*").alias("members"),
                                 F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum_a"),
                                 F.sum(F.xxhash64("cls", F.lit(1)).cast("decimal(38,0)")).alias("sum_b"))
        .groupBy("members", "sum_a", "sum_b").agg(F.min("key").alias("key"), F.first("weight").alias("weight"))
        .select("key", F.ceil(F.col("weight") / block).cast("int").alias("blocks"), "members"))
    cut = join_hot(large, buckets, "key", large.count()).select(
        F.col("key").cast("string").cast("binary").alias("grp"),
        F.pmod(F.xxhash64("cls", F.lit(2)), F.col("blocks")).cast("int").alias("side"), "blocks", "cls", "id", "row_hash")
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return (
        whole.unionByName(cut).select("*", meets)
        .select("grp", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side",
                "cls", "id", "row_hash"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, row_hash, n_shingles, cls, root, component_id), one row per input row.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets, and
    ``component_id`` is the smallest id reachable over links, the document itself included. Words
    are lower-cased (A-Z) runs without white space. A null or word-less text has no shingles, is
    linked with nothing and is its own component (``cls`` is null). Repeated rows and equal ids are
    rows of their own; a null id never becomes a component id unless the whole component has none.
    ``cls`` is a digest of the shingle set, ``root`` that of one class of the component.
    ``row_hash`` is ``xxhash64`` of the text. Other columns are ignored. Shingles are compared as
    64-bit hashes.
    """
    bands = bands_for(percent)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                         F.xxhash64(F.col(text_col)).alias("row_hash"))
    signed = freeze(map_text(source, "text", _signer(shingle, bands),
                             "n_shingles bigint, cls binary, bands array<bigint>", ["id", "row_hash"]))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash")
    classes = freeze(
        signed.filter("cls is not null").groupBy("cls")
        .agg(F.min(key).alias("k"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
        .select("cls", "k.id", "k.row_hash", "n", "bands", "copies"))
    wanted = freeze(_groups(classes, block))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    x, w = source.alias("x"), side.alias("w")
    texts = x.join(w, F.col("x.id").eqNullSafe(F.col("w.id")) & (F.col("x.row_hash") == F.col("w.row_hash")))
    edges = (
        texts.select("w.grp", "w.i", "w.j", "w.side", "w.cls", F.col("x.text").cast("binary").alias("text"))
        .groupBy("grp", "i", "j").applyInPandas(_group_edges(shingle, percent, bands), "a binary, b binary"))
    roots = connected_components(edges)
    linked = freeze(classes.select("cls", "id").join(roots, F.col("cls") == F.col("node")).select("cls", "id", "root"))
    least = freeze(linked.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")))
    of_class = freeze(
        classes.select("cls", "id", "copies")
        .join(join_hot(linked, least, "root", linked.count()).select("cls", "root", "least"), "cls", "left")
        .select("cls", F.coalesce("root", "cls").alias("root"), F.coalesce("least", "id").alias("component_id"), "copies"))
    rows = signed.select("id", "row_hash", "n_shingles", "cls")
    # a class of many copies is one key of the join: the at most HOT_CLASSES classes that hold 1 / HOT_CLASSES
    # of all rows or more are broadcast, the others are joined by an exchange
    many = F.col("copies") >= max(2, rows.count() / HOT_CLASSES)
    hot, cold = F.broadcast(of_class.filter(many).drop("copies")), of_class.filter(~many).drop("copies")
    wordless = rows.filter("cls is null").select("*", F.lit(None).cast("binary").alias("root"), F.col("id").alias("component_id"))
    some = rows.filter("cls is not null")
    return (
        some.join(hot, "cls").unionByName(some.join(hot, "cls", "left_anti").join(cold, "cls")).unionByName(wordless)
        .select("id", "row_hash", "n_shingles", "cls", "root", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
             percent: int = 80) -> DataFrame:
    """The input's rows without near copies: of each component the row with the smallest id stays (null
    ids last), of several such rows the one with the smallest text hash, once. Rows without words are
    in no component and all stay. Columns and their names are the input's.

    Only ids and hashes are grouped; texts are filtered by an anti join with the rows that go.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, percent).filter("cls is not null")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash").alias("k")
    rows = freeze(found.groupBy("root", key).agg(F.count(F.lit(1)).alias("n")))
    best = freeze(rows.groupBy("root").agg(F.min("k").alias("best"), F.count(F.lit(1)).alias("members")))
    judged = freeze(join_hot(rows, best, "root", rows.count()).select("k.id", "k.row_hash", (F.col("k") == F.col("best")).alias("stays"), "n"))
    packed = docs.select(whole_row(docs),
                         F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_hash")).alias("d")

    def same(side: DataFrame, how: str, frame: DataFrame) -> DataFrame:
        side = (F.broadcast(side) if side.count() <= BROADCAST_ROWS else side).alias("s")
        return frame.join(side, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.row_hash") == F.col("s.row_hash")), how)

    left = same(judged.filter("not stays").select("id", "row_hash"), "left_anti", packed).alias("d")
    twice = judged.filter("stays and n > 1").select("id", "row_hash")
    if twice.isEmpty():
        return left.select("row.*")
    once = same(twice, "left_anti", left).select("row")
    several = same(twice, "left_semi", left).groupBy("id", "row_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(several.select("row")).select("row.*")
