"""Column-level scalar functions; everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.model import NODATA, missing_to_null

FLOAT_MAX = 3.4028234663852886e38


def scale_to_unit(v: Column, top: float = 65535.0) -> Column:
    """Raw sensor counts to [0, 1]; a missing value becomes 0."""
    return F.coalesce(missing_to_null(v) / F.lit(top), F.lit(0.0))


def fill_missing(v: Column) -> Column:
    """Missing becomes 0 and infinities the largest float32 of their sign."""
    v = v.cast("double")
    return (
        F.when(v.isNull() | F.isnan(v), 0.0)
        .when(v == float("inf"), FLOAT_MAX)
        .when(v == float("-inf"), -FLOAT_MAX)
        .otherwise(v)
    )


def mark_nodata(burned: Column, soft: Column, threshold: float) -> Column:
    """Sentinel where nothing was burned and the softened value stays under ``threshold``."""
    return F.when((burned == 0) & (soft < threshold), NODATA).otherwise(soft)


def clamp(v: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


def height_confidence(ndsm: Column, threshold: float) -> Column:
    """1 up to the threshold, cubic ease to 0 at twice the threshold; missing heights give 0."""
    t = clamp((ndsm - threshold) / threshold, 0.0, 1.0)
    return F.coalesce(1.0 - t * t * (3.0 - 2.0 * t), F.lit(0.0))


def below(v: Column, threshold) -> Column:
    """Strict comparison that is false, never NULL, for a missing value."""
    return F.coalesce(v < threshold, F.lit(False))


def merge_binary(a: Column, b: Column, mode: str) -> Column:
    _check_mode(mode)
    return (a | b) if mode == "or" else (a & b)


def merge_confidence(a: Column, b: Column, mode: str) -> Column:
    _check_mode(mode)
    return F.greatest(a, b) if mode == "or" else F.least(a, b)


def _check_mode(mode: str) -> None:
    if mode not in ("or", "and"):
        raise ValueError(f"combine mode must be 'or' or 'and', got {mode!r}")


def is_labelled(mask: Column) -> Column:
    return (mask >= 0) & (mask < NODATA)


def soft_blend(mask: Column, confidence: Column, resolve_above: float) -> Column:
    """Dampen labelled cells by the ground confidence; resolve sentinel cells that are surely ground."""
    return (
        F.when(is_labelled(mask), mask * (1.0 - confidence))
        .when((mask == NODATA) & (confidence > resolve_above), 1.0 - confidence)
        .otherwise(mask)
    )


def sigmoid(logit: Column) -> Column:
    """Two-branch form: the exponent is never positive, so it cannot overflow."""
    e = F.exp(-F.abs(logit))
    return F.when(logit >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def predicted(p: Column, threshold) -> Column:
    return p >= threshold


def is_crown(target: Column, threshold) -> Column:
    return target > threshold


def is_valid(target: Column) -> Column:
    return target != NODATA
