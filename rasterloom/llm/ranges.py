"""Dealing rows by ranges of an integer id without sorting or sampling their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_ends(ids: DataFrame, column: str, parts: int) -> list[int]:
    """Upper ends of about even ranges, at most ``parts - 1``, from a quantile sketch of the column."""
    if parts < 2:
        return []
    found = ids.select(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(found or []))


def range_part(column: Column, ends: list[int]) -> Column:
    """Number of the range, ascending with the column; null is 0, the ranges start at 1."""
    above = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < column)) if ends else F.lit(0)
    return F.when(column.isNull(), 0).otherwise(above + 1).cast("int")
