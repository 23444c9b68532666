"""Raster statistics: class counts, audits, percentiles, histograms and automatic thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.pointwise import fill_missing, is_labelled
from rasterloom.model import NODATA
from rasterloom.operators.selection import exact_quantiles
from rasterloom.runtime import freeze, lookup_join

RASTER = ["raster_id"]
#: Percentiles of the height summary.
SUMMARY = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def mask_counts(mask: DataFrame, keys: list[str] = RASTER, column: str = "mask") -> DataFrame:
    m = F.col(column)
    return mask.groupBy(*keys).agg(
        F.count_if((m > 0) & (m < NODATA)).alias("crown"),
        F.count_if(m == 0).alias("zero"),
        F.count_if(m == NODATA).alias("nodata"),
    )


def blend_audit(blended: DataFrame, keys: list[str] = RASTER) -> DataFrame:
    """``blended`` holds mask, conf and final of every cell."""
    before, after = F.col("mask"), F.col("final")
    return blended.groupBy(*keys).agg(
        F.count_if(is_labelled(before) & (F.col("conf") > 0)).alias("dampened"),
        (F.count_if(before == NODATA) - F.count_if(after == NODATA)).alias("resolved"),
        F.count_if((after > 0) & (after < NODATA)).alias("crown"),
        F.count_if(after == 0).alias("ground"),
        F.count_if(after == NODATA).alias("nodata"),
    )


def height_summary(raster: DataFrame, keys: list[str] = RASTER, approximate: bool = False) -> DataFrame:
    """Extremes and percentiles of the non-missing values."""
    probs = SUMMARY
    if approximate:
        q = raster.groupBy(*keys).agg(F.min("v").alias("min"), F.max("v").alias("max"),
                                      *[F.percentile_approx("v", p, 10000).alias(n) for n, p in probs.items()])
    else:
        q = exact_quantiles(raster, keys, "v", probs, extremes=True)
    return q.select(*keys, "min", *probs, "max")


def upper_height(raster: DataFrame, keys: list[str] = RASTER, p: float = 0.95, out: str = "p95") -> DataFrame:
    """A high percentile of the strictly positive values; NULL for a key without any."""
    return exact_quantiles(raster.select(*keys, F.when(F.col("v") > 0, F.col("v")).alias("v")), keys, "v", {out: p})


def minmax_normalise(raster: DataFrame, keys: list[str] = RASTER, out: str = "v") -> DataFrame:
    """Stretch to [0, 1] by the extremes over all bands of a raster."""
    ends = raster.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    joined = lookup_join(raster, ends, keys)
    return joined.withColumn(out, (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).drop("_lo", "_hi")


def value_range(raster: DataFrame, keys: list[str] = RASTER) -> DataFrame:
    """Histogram range per key; an empty range is widened by half a unit on both sides."""
    r = raster.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")).filter("_lo is not null")
    return widened(r, keys)


def widened(ends: DataFrame, keys: list[str], instead: Column | None = None) -> DataFrame:
    pad = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    lo = F.col("_lo") - pad
    return ends.select(*keys, (lo if instead is None else F.coalesce(lo, instead)).alias("lo"), (F.col("_hi") + pad).alias("hi"))


def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def histogram_arrays(raster: DataFrame, keys: list[str] = RASTER, bins: int = 256,
                     limits: tuple[float, float] | None = None) -> DataFrame:
    """One row per key: lo, hi and a dense array of ``bins`` counts (the only per-key collection,
    bounded by the number of bins)."""
    if limits is None:
        ranged = lookup_join(raster, value_range(raster, keys), keys, "inner")
    else:
        ranged = raster.withColumns({"lo": F.lit(float(limits[0])), "hi": F.lit(float(limits[1]))})
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    index = F.when(inside, bin_index(F.col("v"), F.col("lo"), F.col("hi"), bins))
    return dense_counts(ranged.groupBy(*keys, "lo", "hi", index.alias("bin")).agg(F.count(F.lit(1)).alias("n")), keys, bins)


def dense_counts(per_bin: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Counted bins, one row each, as one array per key; a NULL bin only keeps its key."""
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))  # values outside keep their key only
    packed = per_bin.groupBy(*keys, "lo", "hi").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("bigint")))
    return packed.select(*keys, "lo", "hi", dense.alias("counts"))


def histogram(raster: DataFrame, keys: list[str] = RASTER, bins: int = 256,
              limits: tuple[float, float] | None = None) -> DataFrame:
    """Long histogram with empty bins: bin, left, right, n."""
    return long_counts(histogram_arrays(raster, keys, bins, limits), keys, bins)


def long_counts(packed: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Arrays of counts as rows with the edges of their bins."""
    h = packed.select(*keys, "lo", "hi", F.posexplode("counts").alias("bin", "n"))
    width = (F.col("hi") - F.col("lo")) / bins
    left = F.col("lo") + F.col("bin") * width
    return h.select(*keys, "bin", left.alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), "n")


def moving_sum(values: Column, size: int) -> Column:
    """Sum over ``size`` neighbours ``[i - size//2, i - size//2 + size - 1]`` of an array with
    mirrored ends (the end value repeats)."""
    n = F.size(values)

    def mirrored(j):
        m = F.pmod(j, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    def around(i):
        reach = F.sequence(i - size // 2, i - size // 2 + size - 1)
        return F.aggregate(reach, F.lit(0.0), lambda acc, j: acc + F.element_at(values, mirrored(j) + 1))

    return F.transform(F.sequence(F.lit(0), n - 1), around)


def moving_mean(values: Column, size: int = 10) -> Column:
    return F.transform(moving_sum(values, size), lambda s: s / size)


def valley_threshold(raster: DataFrame, keys: list[str] = RASTER, lo: float = 0.3, hi: float = 8.0,
                     bins: int = 300, smooth: int = 10) -> DataFrame:
    """Centre of the first lowest bin of the smoothed histogram; ``lo`` when nothing is in range."""
    return valley_of(histogram_arrays(raster, keys, bins, (lo, hi)), keys, lo, hi, bins, smooth)


def valley_of(packed: DataFrame, keys: list[str], lo: float, hi: float, bins: int, smooth: int) -> DataFrame:
    """The valley of histograms over ``[lo, hi]``."""
    sums = packed.select(*keys, moving_sum(F.transform("counts", lambda c: c.cast("double")), smooth).alias("s"))
    first_low = F.array_position("s", F.array_min("s")) - 1
    valley = lo + (first_low + 0.5) * ((hi - lo) / bins)
    return sums.select(*keys, F.when(F.array_max("s") > 0, valley).otherwise(float(lo)).alias("valley"))


def otsu_threshold(raster: DataFrame, keys: list[str] = RASTER, bins: int = 256) -> DataFrame:
    """Bin centre with the largest between-class variance (the first one on ties).

    Windows run over at most ``bins`` rows per key. Empty bins repeat their predecessor's variance
    and so can never be the first maximum. A key without any finite value has no threshold (NULL);
    :func:`known_threshold` turns that into an error.
    """
    v = F.col("v")
    finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    usable = raster.select(*keys, finite.alias("v"))
    ends = usable.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    ends = freeze(widened(ends, keys, F.lit(None).cast("double")))
    ranged = usable.filter("v is not null").join(ends, keys)
    b = bin_index(F.col("v"), F.col("lo"), F.col("hi"), bins)
    return otsu_of(ends, ranged.groupBy(*keys, "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")), keys, bins)


def otsu_of(ends: DataFrame, per_bin: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The threshold of every key of ``ends`` from its counted bins."""
    per_bin = per_bin.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    upto = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    s = per_bin.select(
        *keys, "bin", "centre",
        F.sum("n").over(upto).alias("c"), F.sum("n").over(whole).alias("t"),
        F.sum(F.col("n") * F.col("centre")).over(upto).alias("m"),
        F.sum(F.col("n") * F.col("centre")).over(whole).alias("mt"),
    )
    w0 = F.col("c") / F.col("t")
    w1 = 1.0 - w0
    mu0 = F.col("m") / F.col("c")
    mu1 = (F.col("mt") / F.col("t") - w0 * mu0) / F.greatest(w1, F.lit(1e-8))
    scored = s.select(*keys, "bin", "centre", (w0 * w1 * (mu0 - mu1) * (mu0 - mu1)).alias("score"))
    best = scored.groupBy(*keys).agg(F.max_by("centre", F.struct("score", -F.col("bin"))).alias("threshold"))
    return ends.select(*keys).join(best, keys, "left")


def known_threshold(thresholds: DataFrame) -> DataFrame:
    """The same table; reading a key without a threshold is an error."""
    missing = F.raise_error(F.lit("otsu_threshold: no finite values")).cast("double")
    return thresholds.withColumn("threshold", F.coalesce("threshold", missing))


def diagnostic_table(raster: DataFrame, used: float | str, suggested: float | str | None = None,
                     keys: list[str] = RASTER, bins: int = 300) -> DataFrame:
    """Histogram of the finite non-negative values plus the marked thresholds."""
    mark = lambda t: F.lit(None).cast("double") if t is None else (F.col(t) if isinstance(t, str) else F.lit(float(t)))
    h = histogram(raster.filter("v >= 0 and v < double('inf')"), keys, bins)
    return h.withColumns({"used": mark(used), "suggested": mark(suggested)})


def channel_stats(pixels: DataFrame) -> DataFrame:
    """Mean and standard deviation per channel of the given patch pixels, missing counted as 0."""
    v = fill_missing(F.col("v"))
    return pixels.groupBy("channel").agg(
        F.avg(v).alias("mean"), F.greatest(F.stddev_pop(v), F.lit(1e-6)).alias("std"))
