"""Exact order statistics by narrowing counts: no sort and no copy of the values.

A double is mapped to a whole number that sorts like it. The first pass counts values by the upper bits
of that number, the next two count, only inside the counted groups that hold a wanted rank, by the
middle and the lower bits. Counts are formed map-side; what is shuffled and ordered is one row per
occupied group, at most ``2 ** 22`` per key however many values there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.runtime import freeze

#: Bits left below the groups of the first, second and third pass.
LEVELS = (42, 21, 0)
#: The second pass counts single values, and is the last, where the groups that hold a wanted rank have
#: no more values than this each: as many rows as any pass may have per key and rank.
FEW = 1 << 21


def sortable(v: Column) -> Column:
    """A 64-bit number that orders doubles as their values do; 0.0 and -0.0 give 0, NaN comes last.

    Exponent and mantissa are taken by arithmetic that is exact: scaling by a power of two.
    """
    size = F.abs(v)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int")
    scaled = lambda e: size / F.pow(F.lit(2.0), e)
    # the logarithm may be off by one beside a power of two
    exponent = F.when(scaled(guess) >= 2.0, guess + 1).when((scaled(guess) < 1.0) & (guess > -1022), guess - 1).otherwise(guess)
    mantissa = scaled(exponent)
    whole = (F.when(mantissa < 1.0, 0).otherwise(exponent + 1023).cast("bigint") * (1 << 52)
             + ((mantissa - F.when(mantissa < 1.0, 0.0).otherwise(1.0)) * float(1 << 52)).cast("bigint"))
    top = F.lit(2047 << 52).cast("bigint")
    bits = F.when(F.isnan(v), top + 1).when(size == float("inf"), top).when(size == 0, F.lit(0).cast("bigint")).otherwise(whole)
    return F.when(v < 0, -bits).otherwise(F.when(v.isNotNull(), bits))


def _holding(counts: DataFrame, scope: list[str], group: str, rank: Column) -> DataFrame:
    """The counted group that holds a rank, and the rank inside it (``at``)."""
    upto = F.sum("_n").over(W.partitionBy(*scope).orderBy(group).rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("_upto", upto).filter((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))).withColumn(
        "at", rank - (F.col("_upto") - F.col("_n")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], extremes: bool = False) -> DataFrame:
    """Linear-interpolation quantiles per key, one column per name in ``probs``; with ``extremes`` also
    ``min`` and ``max``.

    ``df`` is read two or three times, so what is costly to make should be a written table. Missing values
    count 0: a key without values keeps its row, with NULL quantiles. A quantile lies between two order
    statistics; each is followed through the passes. Between passes one row per key and order statistic
    is written.
    """
    values = df.select(*keys, F.col(value).alias("_v")).withColumn("_s", sortable(F.col("_v")))
    group = lambda level: F.shiftright("_s", LEVELS[level])
    first = values.groupBy(*keys, group(0).alias("_g")).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def inside(side: DataFrame, before: int, level: int) -> DataFrame:
        same = group(before) == side["_p"]
        for k in keys:
            same = same & values[k].eqNullSafe(side[f"_k_{k}"])
        return values.join(side, same).groupBy(*keys, "name", "tag", "rank", group(level).alias("_g")).agg(
            F.count("_v").alias("_n"), F.min("_v").alias("_value"))

    return narrowed(keys, probs, first, inside, extremes)


def narrowed(keys: list[str], probs: dict[str, float], first: DataFrame, inside: Callable[[DataFrame, int, int], DataFrame],
             extremes: bool) -> DataFrame:
    """Quantiles from counts however they are taken.

    ``first`` has per key and upper group ``_g`` the number ``_n`` of values and their extremes ``_lo``, ``_hi``;
    a key without values has a group of count 0. ``inside(side, before, level)`` counts, for every row of
    ``side`` (``_k_<key>``, name, tag, rank, and the group ``_p`` of bits ``LEVELS[before]``), the values
    of that group by the bits ``LEVELS[level]``, with their smallest one as ``_value``.
    """
    whole = W.partitionBy(*keys)
    upto = F.sum("_n").over(whole.orderBy("_g").rowsBetween(W.unboundedPreceding, 0))
    counted = first.select("*", upto.alias("_upto"), F.sum("_n").over(whole).alias("_all"),
                           F.min("_lo").over(whole).alias("min"), F.max("_hi").over(whole).alias("max"))
    ranks = {(name, tag): fn(F.lit(float(p)) * (F.col("_all") - 1)) for name, p in probs.items() for tag, fn in (("lo", F.floor), ("hi", F.ceil))}
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(tag).alias("tag"), rank.alias("rank")) for (name, tag), rank in ranks.items()])
    here = F.filter(wanted, lambda t: (t["rank"] >= F.col("_upto") - F.col("_n")) & (t["rank"] < F.col("_upto")))
    # a key without values has one group of count 0, which keeps it
    found = freeze(counted.select(*keys, "min", "max", "_all", "_g", "_n", (F.col("_upto") - F.col("_n")).alias("_below"), here.alias("t"))
                   .filter("_all = 0 or size(t) > 0").select(*keys, "min", "max", "_all", "_g", "_n", "_below", F.explode_outer("t").alias("t")))
    place = found.filter("_all > 0").select(*keys, "t.name", "t.tag", F.col("_g").alias("_p"), (F.col("t.rank") - F.col("_below")).alias("rank"))
    scope = [*keys, "name", "tag"]
    few = (found.agg(F.max("_n")).first()[0] or 0) <= FEW
    for before, level in ((0, 2),) if few else ((0, 1), (1, 2)):
        side = place.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "name", "tag", "rank", "_p")
        held = _holding(inside(side, before, level), scope, "_g", F.col("rank"))
        place = held.select(*scope, F.col("_g").alias("_p"), F.col("at").alias("rank"), F.col("_value").alias("v"))
        if level == 1:
            place = freeze(place)
    at = lambda name, tag: F.max(F.when((F.col("name") == name) & (F.col("tag") == tag), F.col("v"))).alias(f"_{name}_{tag}")
    picked = place.groupBy(*keys).agg(*[at(name, tag) for name in probs for tag in ("lo", "hi")])
    heads = found.groupBy(*keys).agg(F.max("_all").alias("_all"), F.max("min").alias("min"), F.max("max").alias("max"))
    same = F.lit(True)
    for k in keys:
        same = same & heads[k].eqNullSafe(picked[k])
    joined = heads.join(picked, same, "left").select(*[heads[k] for k in keys], "_all", "min", "max", *[c for c in picked.columns if c not in keys])
    final = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("_all") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        final.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return joined.select(*keys, *final, *(["min", "max"] if extremes else []))
