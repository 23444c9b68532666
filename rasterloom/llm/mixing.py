"""Mixing sources to target weights along a time-varying curriculum.

Targets: every source gets a share of all words by its weight, at most ``max_epochs`` times its own
size; the excess is shared among the others by weight until nobody is above. Order: inside a source,
documents follow a digest of their id. A source's schedule says how its demand is spread over
training time; integrated, it gives the words demanded up to each time, and inverted, the time at
which each copy of a document is due. Documents are range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.text import whole_row
from rasterloom.operators.prefix import prefix_sum
from rasterloom.runtime import freeze, lookup_join, shuffle_width

#: (time, weight) knots by weight class: light sources early, heavy ones late; linear in between.
CURRICULUM = {
    1: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(key, source_size, weight, target) from (key, source, source_size), weights 1, 2, 3 repeating
    by code point of the source, null last.

    Water filling in one pass: by fill level (cap / weight) ascending, a source is full when the words
    that fill it and all before it, and raise the rest to its level, do not exceed the total. Both
    orders are distributed running totals, so the number of sources is not bounded by one task.
    """
    named = sizes.select("key", "source_size", F.struct(F.col("source").isNull(), "source").alias("name"), F.lit(1).alias("one"))
    ranked = prefix_sum(named, [], "name", ["one"]).select(
        "key", "source_size", (F.col("source_size") * max_epochs).alias("cap"),
        ((F.col("cum_one") - 1) % 3 + 1).cast("bigint").alias("weight"))
    level = F.struct((F.col("cap") / F.col("weight")).alias("level"), "key")
    filled = prefix_sum(ranked.withColumn("level", level), [], "level", ["cap", "weight", "source_size"])
    total, rest = F.col("all_source_size"), F.col("all_weight") - F.col("cum_weight")
    full = freeze(filled.select(
        "key", "source_size", "cap", "weight", total.alias("total"),
        (F.col("cum_cap") * F.col("weight") + F.col("cap") * rest <= total * F.col("weight")).alias("full")))
    left = full.agg(
        (F.first("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).alias("left"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open")).first()
    rate = float(left["left"]) / left["open"] if left["open"] else 0.0
    return full.select("key", "source_size", "weight",
                       F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.lit(rate) * F.col("weight")).alias("target"))


def _segments(knots) -> Column:
    """The schedule's pieces: start time, width, start weight, slope, words demanded before (share)."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(F.struct(F.lit(t0).alias("t"), F.lit(w0 / area).alias("w"),
                            F.lit((w1 - w0) / (t1 - t0) / area).alias("slope"), F.lit(done).alias("before")))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return F.array(*out)


def due(share: Column, weight: Column, curriculum=None) -> Column:
    """Training time in [0, 1] at which a source of this weight class has given ``share`` of its words:
    the root of the quadratic demand of the piece that ``share`` falls into."""
    curriculum = curriculum or CURRICULUM
    out = None
    for cls, knots in curriculum.items():
        pieces = F.filter(_segments(knots), lambda s: s["before"] <= share)
        s = F.element_at(pieces, -1)
        missing = share - s["before"]
        root = F.sqrt(F.greatest(s["w"] * s["w"] + missing * s["slope"] * 2.0, F.lit(0.0)))
        time = s["t"] + missing * 2.0 / (s["w"] + root)
        out = F.when(weight == cls, time) if out is None else out.when(weight == cls, time)
    return F.least(out, F.lit(1.0))


def _bucket_offsets(fine: DataFrame) -> DataFrame:
    """Words of the same source before each bucket; sums run over at most 256 rows at either level."""
    before1 = W.partitionBy("key").orderBy("b1").rowsBetween(W.unboundedPreceding, -1)
    before2 = W.partitionBy("key", "b1").orderBy("b2").rowsBetween(W.unboundedPreceding, -1)
    first = fine.groupBy("key", "b1").agg(F.sum("n").alias("n")).select(
        "key", "b1", F.coalesce(F.sum("n").over(before1), F.lit(0)).alias("o1"))
    second = fine.select("key", "b1", "b2", F.coalesce(F.sum("n").over(before2), F.lit(0)).alias("o2"))
    return second.join(first, ["key", "b1"]).select("key", "b1", "b2", (F.col("o1") + F.col("o2")).alias("bucket_offset"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        max_epochs: int = 3, curriculum=None, carry: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken, copies, due), one row per input row, range-sorted by due.

    ``copies`` is an array of (pass, words, due): each time the mix takes the document, with the words
    it takes. All but the source's last document are taken whole; that one gives the words that are
    left, so a source's words are its target, rounded. ``taken`` is the sum of the words, ``due`` the
    first time (null if never taken). With ``carry``, ``row`` holds the whole input row.

    The order inside a source is the MD5 of the id (null: of ''), then id, then text hash; equal rows
    are interchangeable. Null or word-less texts have size 0 and are never taken; a null source is a
    source of its own, last in order. Nothing is gathered by source: the digest's first two bytes cut
    a source into 256 x 256 even buckets, documents are ordered only inside one, and the buckets'
    sums give the words before it.
    """
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    row = [whole_row(docs)] if carry else []
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("row_hash"), *row,
    ).select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), digest.alias("digest")).select(
        "*", F.substring("digest", 1, 2).alias("b1"), F.substring("digest", 3, 2).alias("b2"))
    if not carry:
        sized = freeze(sized)
    fine = freeze(sized.groupBy("key", "source", "b1", "b2").agg(F.sum("size").alias("n")))
    sizes = freeze(fine.groupBy("key", "source").agg(F.sum("n").alias("source_size")))
    before = W.partitionBy("key", "b1", "b2").orderBy("digest", "id", "row_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.join(_bucket_offsets(fine), ["key", "b1", "b2"]).withColumn(
        "before", F.col("bucket_offset") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    budget = F.round("target").cast("bigint")

    def copy(k):
        start = F.col("before") + k * F.col("source_size")
        took = F.greatest(F.lit(0), F.least(budget - start, F.col("size")))
        return F.struct(k.cast("int").alias("pass"), took.alias("words"),
                        due(start.cast("double") / F.greatest(budget, F.lit(1)), F.col("weight"), curriculum).alias("due"))

    passes = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(max_epochs - 1).cast("bigint")), copy)
    out = (
        lookup_join(placed, targets(sizes, max_epochs), "key")
        .withColumn("copies", F.filter(passes, lambda c: c["words"] > 0))
        .withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]))
        .withColumn("due", F.get("copies", F.lit(0))["due"]))
    wanted = out.select("id", "size", "source_size", "target", "taken", "copies", "due", "digest",
                        *(["row"] if carry else []))
    return wanted if carry else _by_due(wanted, "due")


def _by_due(df: DataFrame, column: str) -> DataFrame:
    order = [F.coalesce(F.col(column), F.lit(2.0)), F.col("digest")]
    return df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               max_epochs: int = 3, curriculum=None) -> DataFrame:
    """The training stream: the input's rows, once per copy, in the order in which they are due.

    Documents stay whole here: the one copy per source that its target cuts counts as a copy when at
    least half of its words are taken.
    """
    planned = mix(docs, id_col, source_col, text_col, max_epochs, curriculum, carry=True)
    each = planned.select("row", "size", "digest", F.explode("copies").alias("copy")).filter("2 * copy.words >= size")
    return _by_due(each.select("row", "digest", F.col("copy.due").alias("at")), "at").select("row.*")
