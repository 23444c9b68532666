"""Statistics of tiles and patches: one narrow pass gives partials that merge by aggregation.

A tile's cells stay in its array. A kernel turns the array into a few rows (counts, extremes, bins,
groups of order statistics), which Spark adds up map-side and shuffles by key; a tile gives at most as
many rows as it has bins or occupied groups. ``keys`` are columns of the tile table, missing cells are
NULL in the arrays and take no part, and a key whose tiles hold no value keeps its row. Results equal
those of the pixel forms in ``stats`` and ``patches``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.model import NODATA, list_rows, tile_batches, tile_grid, tiles_per_block
from rasterloom.operators import selection, stats
from rasterloom.operators.stats import RASTER
from rasterloom.runtime import freeze, lookup_join

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def per_tile(tiles: DataFrame, keys: list[str], arrays: list[str], kernel: Callable[..., tuple], schema: str,
             scalars: list[str] | None = None) -> DataFrame:
    """Rows of a kernel after the keys of each tile; narrow.

    ``kernel`` gets the arrays (NaN is missing) and then the scalars of one tile, and returns one
    sequence per column of ``schema``, all of one length; NaN becomes NULL.
    """
    chosen = tiles.select(*keys, *arrays, *(scalars or []))
    fields = StructType.fromDDL(schema).fields
    types = [_ARROW[f.dataType.simpleString()] for f in fields]
    names = [*keys, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = [list_rows(batch.column(len(keys) + i)) for i in range(len(arrays))]
            of += [batch.column(i).to_pylist() for i in range(len(keys) + len(arrays), batch.num_columns)]
            found = [kernel(*row) for row in zip(*of)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            made = [pa.array(list(chain.from_iterable(f[j] for f in found)) if t == pa.binary() else np.concatenate([f[j] for f in found]), t,
                             from_pandas=True) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *made], names=names)

    return tile_batches(chosen).mapInArrow(run, StructType([*(chosen.schema[k] for k in keys), *fields]))


def _one(*values) -> tuple:
    return tuple(np.array([v]) for v in values)


def _present(data: np.ndarray) -> np.ndarray:
    return data[~np.isnan(data)]


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def mask_counts(tiles: DataFrame, keys: list[str] = RASTER, column: str = "data") -> DataFrame:
    """Cells of crowns, of ground and without a label."""
    count = lambda m: _one(((m > 0) & (m < NODATA)).sum(), (m == 0).sum(), (m == NODATA).sum())
    return _summed(per_tile(tiles, keys, [column], count, "crown bigint, zero bigint, nodata bigint"), keys)


def blend_audit(tiles: DataFrame, keys: list[str] = RASTER) -> DataFrame:
    """What blending changed, from the arrays ``mask``, ``conf`` and ``final`` of each tile."""

    def count(mask: np.ndarray, conf: np.ndarray, final: np.ndarray) -> tuple:
        after = final == NODATA
        return _one(((mask >= 0) & (mask < NODATA) & (conf > 0)).sum(), (mask == NODATA).sum() - after.sum(),
                    ((final > 0) & (final < NODATA)).sum(), (final == 0).sum(), after.sum())

    return _summed(per_tile(tiles, keys, ["mask", "conf", "final"], count,
                            "dampened bigint, resolved bigint, crown bigint, ground bigint, nodata bigint"), keys)


# order statistics -------------------------------------------------------------------------------
def ordinals(v: np.ndarray) -> np.ndarray:
    """The numbers of ``selection.sortable``: the bits of the size, negative for negative values."""
    bits = np.abs(v).view(np.int64)
    return np.where(v < 0, -bits, bits)


def _runs(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return starts, np.append(starts[1:], len(groups))


def quantiles(tiles: DataFrame, keys: list[str], probs: dict[str, float], extremes: bool = False, column: str = "data",
              positive: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per key by the narrowing counts of ``selection``, taken
    inside the tiles; with ``positive`` only of values above 0. The table is read two or three times."""
    usable = (lambda d: d[d > 0]) if positive else _present

    def upper(data: np.ndarray) -> tuple:
        v = np.sort(usable(data))
        if not len(v):
            return _one(np.iinfo(np.int64).min, 0, np.nan, np.nan)
        g = ordinals(v) >> selection.LEVELS[0]
        a, b = _runs(g)
        return g[a], b - a, v[a], v[b - 1]

    first = per_tile(tiles, keys, [column], upper, "_g bigint, _n bigint, _lo double, _hi double").groupBy(*keys, "_g").agg(
        F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    def inside(side: DataFrame, before: int, level: int) -> DataFrame:
        def narrower(data: np.ndarray, held: list[int]) -> tuple:
            v = usable(data)
            o = ordinals(v)
            kept = np.isin(o >> selection.LEVELS[before], np.array(held, np.int64))
            order = np.argsort(o[kept], kind="stable")
            v, o = v[kept][order], o[kept][order]
            g = o >> selection.LEVELS[level]
            if not len(g):
                return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
            a, b = _runs(g)
            return o[a] >> selection.LEVELS[before], g[a], b - a, v[a]

        # at most two groups per quantile and key
        held = freeze(side.groupBy(*[f"_k_{k}" for k in keys]).agg(F.collect_set("_p").alias("_held")))
        wanted = tiles.select(*keys, column).join(held, _same(tiles, held, keys)).select(*[tiles[k] for k in keys], column, "_held")
        counts = per_tile(wanted, keys, [column], narrower, "_p bigint, _g bigint, _n bigint, _value double", ["_held"])
        merged = counts.groupBy(*keys, "_p", "_g").agg(F.sum("_n").alias("_n"), F.min("_value").alias("_value"))
        return merged.join(side, _same(merged, side, keys) & (merged["_p"] == side["_p"])).select(
            *[merged[k] for k in keys], "name", "tag", "rank", "_g", "_n", "_value")

    return selection.narrowed(keys, probs, first, inside, extremes)


def _same(left: DataFrame, side: DataFrame, keys: list[str]):
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(side[f"_k_{k}"])
    return same


def height_summary(tiles: DataFrame, keys: list[str] = RASTER, column: str = "data") -> DataFrame:
    q = quantiles(tiles, keys, stats.SUMMARY, extremes=True, column=column)
    return q.select(*keys, "min", *stats.SUMMARY, "max")


def upper_height(tiles: DataFrame, keys: list[str] = RASTER, p: float = 0.95, out: str = "p95", column: str = "data") -> DataFrame:
    """A high percentile of the strictly positive values; NULL for a key without any."""
    return quantiles(tiles, keys, {out: p}, column=column, positive=True)


# histograms -------------------------------------------------------------------------------------
def _binned(data: np.ndarray, lo: float, hi: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    inside = data[(data >= lo) & (data <= hi)]
    at = np.minimum(np.floor((inside - lo) / (hi - lo) * bins), bins - 1).astype(np.int64)
    n = np.bincount(at, minlength=bins)
    return np.flatnonzero(n), n[n > 0]


def _ends(tiles: DataFrame, keys: list[str], column: str, finite: bool = False) -> DataFrame:
    def extremes(data: np.ndarray) -> tuple:
        v = data[np.isfinite(data)] if finite else _present(data)
        return _one(v.min(), v.max()) if len(v) else _one(np.nan, np.nan)

    return per_tile(tiles, keys, [column], extremes, "_lo double, _hi double").groupBy(*keys).agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))


def histogram_arrays(tiles: DataFrame, keys: list[str] = RASTER, bins: int = 256,
                     limits: tuple[float, float] | None = None, column: str = "data") -> DataFrame:
    """One row per key: lo, hi and ``bins`` counts; the range is the key's own without ``limits``."""
    if limits is None:
        ranged = lookup_join(tiles, stats.widened(_ends(tiles, keys, column).filter("_lo is not null"), keys), keys, "inner")
    else:
        ranged = tiles.withColumns({"lo": F.lit(float(limits[0])), "hi": F.lit(float(limits[1]))})

    def count(data: np.ndarray, lo: float, hi: float) -> tuple:
        at, n = _binned(data, lo, hi, bins)
        return np.append(at, np.nan), np.append(n, 0)  # the last row keeps the key

    parts = per_tile(ranged.select(*keys, "lo", "hi", column, F.col("lo").alias("_a"), F.col("hi").alias("_b")), [*keys, "lo", "hi"],
                     [column], count, "bin int, n bigint", ["_a", "_b"])
    return stats.dense_counts(parts.groupBy(*keys, "lo", "hi", "bin").agg(F.sum("n").alias("n")), keys, bins)


def histogram(tiles: DataFrame, keys: list[str] = RASTER, bins: int = 256, limits: tuple[float, float] | None = None,
              column: str = "data") -> DataFrame:
    """Long histogram with empty bins: bin, left, right, n."""
    return stats.long_counts(histogram_arrays(tiles, keys, bins, limits, column), keys, bins)


def valley_threshold(tiles: DataFrame, keys: list[str] = RASTER, lo: float = 0.3, hi: float = 8.0, bins: int = 300,
                     smooth: int = 10, column: str = "data") -> DataFrame:
    return stats.valley_of(histogram_arrays(tiles, keys, bins, (lo, hi), column), keys, lo, hi, bins, smooth)


def otsu_threshold(tiles: DataFrame, keys: list[str] = RASTER, bins: int = 256, column: str = "data") -> DataFrame:
    """Of the finite values; NULL for a key without any."""
    ends = freeze(stats.widened(_ends(tiles, keys, column, finite=True), keys, F.lit(None).cast("double")))
    ranged = tiles.select(*keys, column).join(ends.filter("lo is not null"), keys)
    parts = per_tile(ranged.select(*keys, "lo", "hi", column, F.col("lo").alias("_a"), F.col("hi").alias("_b")), [*keys, "lo", "hi"],
                     [column], lambda data, lo, hi: _binned(data, lo, hi, bins), "bin int, n bigint", ["_a", "_b"])
    return stats.otsu_of(ends, parts.groupBy(*keys, "lo", "hi", "bin").agg(F.sum("n").alias("n")), keys, bins)


# patches ----------------------------------------------------------------------------------------
def channel_stats(patches: DataFrame) -> DataFrame:
    """Mean and standard deviation per channel of patch arrays, missing counted as 0.

    A patch gives its count, mean and squared deviations; these few numbers are written, and deviations
    about the channel's mean follow from them without cancellation.
    """

    def moments(data: np.ndarray) -> tuple:
        v = np.nan_to_num(data, nan=0.0, posinf=np.inf, neginf=-np.inf)
        if not len(v):
            return _one(0, 0.0, 0.0)
        mean = v.mean()
        return _one(len(v), mean, np.square(v - mean).sum())

    parts = freeze(per_tile(patches, ["channel"], ["data"], moments, "n bigint, m double, d double"))
    whole = parts.groupBy("channel").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    spread = F.sum(F.col("d") + F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)) / F.first("_n")
    return lookup_join(parts, whole, "channel", "inner").groupBy("channel", "mean").agg(
        F.greatest(F.sqrt(spread), F.lit(1e-6)).alias("std"))


def nodata_fractions(mask: DataFrame, image: DataFrame, meta: DataFrame, size: int) -> DataFrame:
    """``patches.nodata_fractions`` of tiles whose side is the patch's.

    The mask is counted where it lies. An image band sends one bit per cell that is not 0 to its
    patch, where the bands' bits are united: a 64th of the cells' bytes, and no row per cell.
    """
    place = ["raster_id", "ty", "tx"]
    lost = per_tile(mask, place, ["data"], lambda m: _one((m == NODATA).sum()), "_nodata bigint")
    bits = per_tile(image, place, ["data"], lambda d: ([np.packbits(~np.isnan(d) & (d != 0)).tobytes()],), "bits binary")

    n = tiles_per_block(size)

    def unite(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], np.ndarray] = {}
        for at, row in zip(zip(table.column("ty").to_pylist(), table.column("tx").to_pylist()), table.column("bits").to_pylist()):
            row = np.frombuffer(row, np.uint8)
            found[at] = found[at] | row if at in found else row
        ty, tx = zip(*found)
        seen = [int(np.unpackbits(v).sum()) for v in found.values()]
        return pa.table({"raster_id": pa.array([key[0].as_py()] * len(ty), pa.string()), "ty": pa.array(ty, pa.int32()),
                         "tx": pa.array(tx, pa.int32()), "_seen": pa.array(seen, pa.int64())})

    block = [F.expr(f"{c} div {n}").cast("int").alias(f"_b{c}") for c in ("ty", "tx")]
    seen = bits.groupBy("raster_id", *block).applyInArrow(unite, "raster_id string, ty int, tx int, _seen bigint")
    area = size * size
    return (
        tile_grid(meta, size).select(*place).join(_summed(lost, place), place, "left").join(seen, place, "left")
        .select("raster_id", F.col("ty").cast("bigint").alias("pr"), F.col("tx").cast("bigint").alias("pc"),
                (F.coalesce("_nodata", F.lit(0)) / float(area)).alias("mask_nodata"),
                ((F.lit(area) - F.coalesce("_seen", F.lit(0))) / float(area)).alias("image_zero")))
