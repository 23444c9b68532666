"""Removal of boilerplate lines by the number of distinct sites on which they stand.

Only lines that occur at least as often as the threshold can reach it; for those, a HyperLogLog sketch
of the sites is built per line and merged by aggregation. Estimates near the threshold are settled by
exact distinct counts. A line found on enough sites is removed everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.runtime import freeze

#: Sketch size (2**LG registers) and the relative standard error it has.
LG = 12
ERROR = 1.04 / math.sqrt(2**LG)
#: Standard errors around the threshold within which an exact count decides.
DOUBT = 6.0
#: Rows up to which a list of lines is broadcast (16 bytes of key each).
BROADCAST_ROWS = 500_000
#: A text with at least this share of all rows is dealt over several keys of the last join (of 1 / HOT_TEXTS).
HOT_TEXTS = 1000


def _checked(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _line_keys(text: Column) -> Column:
    """Two hashes per line, null for a blank one."""
    key = lambda v: F.when(v != "", F.struct(F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2")))
    return F.transform(F.transform(F.split(text, "\n"), _trimmed), key)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def spread_lines(lines: DataFrame, sites: int) -> DataFrame:
    """(h1, h2, spread) of the lines found on at least ``sites`` sites; ``spread`` is the estimate, or
    the exact count where the estimate was in doubt. ``lines`` has (h1, h2, site); null is no site."""
    often = freeze(lines.groupBy("h1", "h2").agg(F.count("site").alias("n")).filter(F.col("n") >= sites).select("h1", "h2"))
    known = lines.filter("site is not null").join(_checked(often), ["h1", "h2"])
    estimate = freeze(known.groupBy("h1", "h2").agg(F.round(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG)))).cast("bigint").alias("spread")))
    margin = max(1.0, DOUBT * ERROR * sites)
    doubtful = estimate.filter(F.abs(F.col("spread") - sites) <= margin).select("h1", "h2")
    exact = (
        known.join(_checked(doubtful), ["h1", "h2"]).select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("spread")).filter(F.col("spread") >= sites))
    return estimate.filter(F.col("spread") > sites + margin).unionByName(exact)


def drop_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                      sites: int = 5) -> DataFrame:
    """(id, text, n_lines, n_removed): texts without the lines found on at least ``sites`` distinct sites.

    Lines end at ``\\n`` and are compared trimmed of ASCII white space, case kept; lines that are blank
    then are never counted or removed. A null text stays null with 0 lines; an empty text is one blank
    line. A null site adds to no line's spread, but its documents are cleaned as well. Repeated rows
    are cleaned alike. The same text has the same lines to remove, so places are kept per distinct text.

    Texts are read twice: once for the hashes of their lines, which are written, and once to be cut.
    Places of copies combine in the task; a text that holds a ``HOT_TEXTS``-th of all rows or more meets
    its places under several keys, none with more than about that share of the rows (rows equal in id, site
    and text stay together).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))
    text_key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    keys = freeze(rows.select("site", *text_key, _line_keys(F.col("text")).alias("lines")))
    each = keys.select("site", F.explode("lines").alias("line")).filter("line is not null").select("line.h1", "line.h2", "site")
    gone = freeze(spread_lines(each, sites).select("h1", "h2"))
    places = (
        keys.select("t1", "t2", F.posexplode("lines").alias("pos", "line")).filter("line is not null")
        .select("t1", "t2", "pos", "line.h1", "line.h2").join(_checked(gone), ["h1", "h2"])
        .groupBy("t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("cut")))
    before = F.concat(F.array(F.lit(-1)), F.slice("cut", 1, F.size("cut") - 1))
    share = F.lit(max(1.0, keys.count() / HOT_TEXTS))
    hot = F.broadcast(freeze(  # at most HOT_TEXTS rows
        keys.groupBy("t1", "t2").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("deals"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & (F.col("n") >= share)).drop("n")))
    dealt = (
        places.select("t1", "t2", F.zip_with("cut", before, lambda p, q: p - q - 1).alias("runs")).join(hot, ["t1", "t2"], "left")
        .select("t1", "t2", "runs", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("deal")))
    keyed = (
        rows.select("id", "text", "site", *text_key).join(hot, ["t1", "t2"], "left")
        .withColumn("deal", F.pmod(F.xxhash64("id", "site"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals", "site"))
    # lines kept before each removed one, then that one; the lines after the last removed one have no entry
    keep = F.flatten(F.transform("runs", lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False)))))
    marked = F.arrays_zip(F.split("text", "\n").alias("line"), keep.alias("keep"))
    kept = F.transform(F.filter(marked, lambda m: F.coalesce(m["keep"], F.lit(True))), lambda m: m["line"])
    return keyed.join(dealt, ["t1", "t2", "deal"], "left").select(
        "id", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("bigint").alias("n_removed"))
