"""Deterministic draws: the same (seed, scope, id) gives the same number on every attempt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A multiplicative generator modulo 2**31 - 1.
LEHMER_M = 2147483647
LEHMER_A = 48271


def digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def key31(*parts) -> Column:
    """An integer below 2**31 - 1 from the first 8 hex digits."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint") % LEHMER_M


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def between(lo: float, hi: float, *parts) -> Column:
    return F.lit(float(lo)) + F.lit(float(hi - lo)) * uniform(*parts)


def step(state: Column, times: int = 1) -> Column:
    """Advance a multiplicative generator; integer arithmetic only, cheap per pixel."""
    for _ in range(times):
        state = (state * F.lit(LEHMER_A).cast("bigint")) % F.lit(LEHMER_M).cast("bigint")
    return state


def unit(state: Column) -> Column:
    return state.cast("double") / F.lit(float(LEHMER_M))


def pixel_state(key: Column, position: Column) -> Column:
    """A non-zero generator state per (key, pixel position)."""
    return (key + position * F.lit(40014).cast("bigint")) % F.lit(LEHMER_M - 1).cast("bigint") + F.lit(1).cast("bigint")
