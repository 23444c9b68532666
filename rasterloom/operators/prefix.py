"""Running sums and ranks that never sort one whole group inside one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.runtime import freeze, shuffle_width

_COMBINE = {
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def prefix_sum(df: DataFrame, keys: list[str], order: str, amounts: list[str],
               descending: bool = False) -> DataFrame:
    """Inclusive running totals ``cum_<amount>`` of ``amounts`` by ``order`` within ``keys``, and the
    totals ``all_<amount>`` of the whole key.

    ``(keys, order)`` must be unique (aggregate first; that also removes skew from repeated
    values); amounts are whole numbers. One exchange: the input is range-partitioned and sorted, each
    range gets a running total in one narrow pass, and the result is written once, so that range
    numbers cannot change on a retry. Per key and range, the total before its first row and its sum
    (one row per range, plus one per key) are joined back as a lookup.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    counted = df.withColumns({f"_run_{a}": F.col(a).cast("bigint") for a in amounts} | {"_nth": F.lit(1).cast("bigint")})
    ranged = (
        counted.repartitionByRange(shuffle_width(df.sparkSession), *keys, direction)
        .sortWithinPartitions(*keys, direction).withColumn("_part", F.spark_partition_id()))
    placed = freeze(ranged.mapInArrow(partial(_range_totals, ["_nth", *[f"_run_{a}" for a in amounts]]), ranged.schema))
    scope = [*keys, "_part"]
    per_range = placed.groupBy(*scope).agg(
        *[F.sum(F.col(a).cast("bigint")).alias(a) for a in amounts],
        *[F.min_by(F.col(f"_run_{a}") - F.coalesce(F.col(a).cast("bigint"), F.lit(0)), "_nth").alias(f"_base_{a}") for a in amounts])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_range.select(
        *scope, *[(F.coalesce(F.sum(a).over(earlier), F.lit(0)) - F.col(f"_base_{a}")).alias(f"_off_{a}") for a in amounts],
        *[F.sum(a).over(whole).alias(f"all_{a}") for a in amounts])
    small = freeze(offsets)
    same = [placed[c].eqNullSafe(small[c]) for c in scope]
    out = placed.join(small, same).select(placed["*"], *[small[c] for c in small.columns if c not in scope])
    for a in amounts:
        out = out.withColumn(f"cum_{a}", F.col(f"_run_{a}") + F.col(f"_off_{a}"))
    return out.drop("_part", "_nth", *[f"_off_{a}" for a in amounts], *[f"_run_{a}" for a in amounts])


def _range_totals(columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace whole-number columns by their running totals over the partition's rows in order."""
    carried = dict.fromkeys(columns, 0)
    for batch in batches:
        for name in columns:
            at = batch.schema.get_field_index(name)
            total = np.cumsum(pc.fill_null(batch.column(at), 0).to_numpy(zero_copy_only=False)) + carried[name]
            if len(total):
                carried[name] = int(total[-1])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(total, pa.int64()))
        yield batch


def running(df: DataFrame, keys: list[str], position: str, column: str, how: str, out: str,
            inclusive: bool = True, block: int = 4096) -> DataFrame:
    """Running min, max or sum along a dense integer ``position``.

    Windows cover one block of positions; block results are carried over through a table that is
    ``block`` times smaller, so a key holding most of the rows is still spread over many tasks.
    """
    agg, merge = _COMBINE[how]
    parts = df.withColumn("_blk", F.floor(F.col(position) / block))
    scope = [*keys, "_blk"]
    earlier = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        parts.groupBy(*scope).agg(agg(column).alias("_t"))
        .select(*scope, agg("_t").over(earlier).alias("_carry"))
    )
    inside = W.partitionBy(*scope).orderBy(position).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return (
        parts.join(carry, scope)
        .withColumn(out, merge(agg(column).over(inside), F.col("_carry")))
        .drop("_blk", "_carry")
    )


def hash_rank(df: DataFrame, keys: list[str], digest: Column, tie: str, out: str = "rank") -> DataFrame:
    """1-based rank by a hex digest within ``keys``, and the number of rows ``total`` of the key.

    A digest is uniform, so its first four hex digits split every key into 65 536 even buckets;
    ranks are bucket offsets plus the position inside the bucket. No global sort, no sampling.
    """
    hashed = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 4))
    scope = [*keys, "_b"]
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
        .select(*scope, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
                F.sum("_n").over(W.partitionBy(*keys)).alias("total"))
    )
    inside = W.partitionBy(*scope).orderBy("_h", tie)
    return (
        hashed.join(offsets, scope)
        .withColumn(out, F.row_number().over(inside) + F.col("_off"))
        .drop("_h", "_b", "_off")
    )
