"""Bilinear resampling between affine grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.pointwise import scale_to_unit
from rasterloom.model import BLOCK_SIDE, TILE_SCHEMA, cell_parts, cells, list_rows, strip_batches, tile_batches, tile_grid, tile_table
from rasterloom.operators.overlay import select_bands
from rasterloom.runtime import freeze, lookup_join

_AXES = [f"{g}_{c}" for g in "st" for c in ("height", "width", "x0", "y0", "px", "py")]
_WINDOW = pa.schema([
    ("raster_id", pa.string()), ("band", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()), ("sy", pa.int64()), ("sx", pa.int64()),
    ("sh", pa.int32()), ("sw", pa.int32()), ("ky", pa.int32()), ("kx", pa.int32()), *[(c, pa.float64()) for c in _AXES], ("data", pa.list_(pa.float64()))])
_WINDOW_SCHEMA = ("raster_id string, band int, ty int, tx int, sy bigint, sx bigint, sh int, sw int, ky int, kx int, "
                  + ", ".join(f"{c} double" for c in _AXES) + ", data array<double>")


#: Side of the target blocks in which the pixel form sums.
PIXEL_BLOCK = 64


class _Line:
    """One axis of the pixel form, as columns.

    A target centre lies at ``slope * t + offset`` in source index units. The kernel is a triangle
    of half-width ``max(1, |slope|)``: plain bilinear when enlarging, area-aware when shrinking. The
    slope is negative where the two grids' axes point in opposite directions.
    """

    def __init__(self, at: str, size: str, origin: str, count: str):
        self.at, self.count, self.block, self.out, self.weight = at, count, f"_b{at}", f"_t{at}", f"_w{at}"
        self.slope = F.col(f"t_{size}") / F.col(f"s_{size}")
        self.offset = (F.col(f"t_{size}") * 0.5 + F.col(f"t_{origin}") - F.col(f"s_{origin}")) / F.col(f"s_{size}") - 0.5
        self.reach = F.greatest(F.abs(self.slope), F.lit(1.0))
        low, high = ((F.col(at) + d * self.reach - self.offset) / self.slope for d in (-1, 1))
        self.first = F.greatest(F.ceil(F.least(low, high)), F.lit(0))
        self.last = F.least(F.floor(F.greatest(low, high)), F.col(f"t_{count}") - 1)

    def to_blocks(self, df: DataFrame) -> DataFrame:
        blocks = F.sequence(F.floor(self.first / PIXEL_BLOCK), F.floor(self.last / PIXEL_BLOCK))
        return df.filter(self.first <= self.last).withColumn(self.block, F.explode(blocks))

    def to_targets(self, df: DataFrame) -> DataFrame:
        """Every row at the target positions of its block that its source position weighs on."""
        start = F.col(self.block) * PIXEL_BLOCK
        inside = F.sequence(F.greatest(self.first, start), F.least(self.last, start + (PIXEL_BLOCK - 1)))
        centre = self.slope * F.col(self.out) + self.offset
        sent = df.withColumn(self.out, F.explode(inside)).withColumns(
            {"_c": centre, self.weight: 1.0 - F.abs(F.col(self.at) - centre) / self.reach})
        # a neighbour on the very edge of the kernel weighs nothing, whatever the rounding of its position
        within = (F.col("_c") >= -0.5) & (F.col("_c") <= F.col(f"s_{self.count}") - 0.5)
        return sent.filter((F.col(self.weight) > 1e-9) & within).drop("_c")


def resample_bilinear(raster: DataFrame, source: DataFrame, target: DataFrame, bands: int = 1) -> DataFrame:
    """Values on the target grid: the weighted mean of the present neighbours.

    Each source cell is shuffled once per block of target cells that it reaches, and sent there to the few
    cells it weighs on; there is no neighbour join. Partitions follow the larger grid's cells, times
    ``bands``. Targets outside the source, or without any present neighbour, get no row (missing).
    ``raster`` holds raster_id, band, y, x, v.
    """
    names = ["height", "width", "x0", "y0", "px", "py"]
    s = source.select("raster_id", *[F.col(c).alias(f"s_{c}") for c in names])
    t = target.select("raster_id", *[F.col(c).alias(f"t_{c}") for c in names])
    pairs = freeze(s.join(t, "raster_id"))
    size = lambda g: cell_parts(pairs.select(F.col(f"{g}_height").alias("height"), F.col(f"{g}_width").alias("width")))
    parts = max(size("s"), size("t")) * bands

    down, across = _Line("y", "py", "y0", "height"), _Line("x", "px", "x0", "width")
    placed = raster.filter("v is not null").join(pairs, "raster_id")
    dealt = across.to_blocks(down.to_blocks(placed)).repartition(parts, "raster_id", "band", "_by", "_bx")
    sent = across.to_targets(down.to_targets(dealt))
    w = F.col("_wy") * F.col("_wx")
    return (
        sent.groupBy("raster_id", "band", "_by", "_bx", F.col("_ty").alias("y"), F.col("_tx").alias("x"))
        .agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v")).drop("_by", "_bx")
    )


def resample_image(raster: DataFrame, bands: list[int], source: DataFrame, target: DataFrame,
                   top: float = 65535.0) -> DataFrame:
    """Pick and order bands, resample, scale to [0, 1]; cells without a value are 0."""
    target = freeze(target)
    parts = cell_parts(target) * len(bands)
    moved = resample_bilinear(select_bands(raster, bands), source, target, len(bands)).repartition(parts, "raster_id", "y")
    grid = cells(target, parts).withColumn("band", F.explode(F.array(*[F.lit(i + 1) for i in range(len(bands))])))
    full = grid.join(moved, ["raster_id", "band", "y", "x"], "left")
    return full.withColumn("v", scale_to_unit(F.col("v"), top))


# tile form --------------------------------------------------------------------------------------
class _Axis:
    """One axis of a pair of grids: a target centre ``t`` lies at ``slope * t + offset`` in source index units."""

    def __init__(self, a: dict, size: str, origin: str, count: str):
        self.slope = a[f"t_{size}"] / a[f"s_{size}"]
        self.offset = (a[f"t_{size}"] * 0.5 + a[f"t_{origin}"] - a[f"s_{origin}"]) / a[f"s_{size}"] - 0.5
        self.reach = max(abs(self.slope), 1.0)
        self.n_source, self.n_target = int(a[f"s_{count}"]), int(a[f"t_{count}"])

    def targets(self, start: int, stop: int) -> tuple[int, int]:
        """The range of target cells on which any source cell of [start, stop) may weigh."""
        ends = sorted(((start - self.reach - self.offset) / self.slope, (stop - 1 + self.reach - self.offset) / self.slope))
        return max(0, int(np.floor(ends[0]))), min(self.n_target, int(np.ceil(ends[1])) + 1)

    def sources(self, start: int, stop: int) -> tuple[int, int]:
        """The range of source cells that may weigh on any target cell of [start, stop)."""
        ends = sorted((self.slope * start + self.offset, self.slope * (stop - 1) + self.offset))
        return max(0, int(np.floor(ends[0] - self.reach))), min(self.n_source, int(np.ceil(ends[1] + self.reach)) + 1)

    def weights(self, targets: tuple[int, int], sources: tuple[int, int]) -> np.ndarray:
        centre = self.slope * np.arange(*targets) + self.offset
        w = 1.0 - np.abs(np.arange(*sources)[None, :] - centre[:, None]) / self.reach
        inside = (centre >= -0.5) & (centre <= self.n_source - 0.5)
        return np.where((w > 1e-9) & inside[:, None], w, 0.0)


def _axes(a: dict) -> tuple[_Axis, _Axis]:
    return _Axis(a, "py", "y0", "height"), _Axis(a, "px", "x0", "width")


def resample_tiles(tiles: DataFrame, source: DataFrame, target: DataFrame, size: int, out_size: int,
                   wanted: DataFrame | None = None, seen: bool = False, home: DataFrame | None = None) -> DataFrame:
    """Tiles of side ``size`` on the source grid as tiles of side ``out_size`` on the target grid.

    Every source tile sends each target block the part of it that weighs there; a block is two matrix
    products. A block is ``ky`` by ``kx`` target tiles: as many as keep it and the source cells below it within
    ``BLOCK_SIDE`` a side, at least one. Cells are never rows. Values equal :func:`resample_bilinear`; target tiles that
    receive nothing are absent. ``wanted`` (raster_id, ty, tx) keeps other targets from being sent to; with
    ``home`` (raster_id, grid_id) its ids are those of the grids that the rasters go to.
    With ``seen``, a column counts the tile's cells that are neither missing nor 0 in some band.
    """
    names = ["height", "width", "x0", "y0", "px", "py"]
    number = lambda side, d: d.select("raster_id", *[F.col(c).cast("double").alias(f"{side}_{c}") for c in names])
    per_block = lambda size: F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SIDE) / (out_size * F.greatest(
        F.lit(1.0), F.abs(F.col(f"t_{size}") / F.col(f"s_{size}")))))).cast("int")
    pairs = freeze(number("s", source).join(number("t", target), "raster_id").withColumns({"ky": per_block("py"), "kx": per_block("px")}))
    placed = tiles.join(pairs, "raster_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        axes = {}  # of a raster
        for batch in batches:
            rows = batch.drop_columns(["data"]).to_pylist()
            for row, flat in zip(rows, list_rows(batch.column(batch.schema.get_field_index("data")))):
                rid, ky, kx = row["raster_id"], row["ky"], row["kx"]
                ay, ax = axes[rid] if rid in axes else axes.setdefault(rid, _axes(row))
                y0, x0, block = row["ty"] * size, row["tx"] * size, flat.reshape(row["h"], row["w"])
                (ya, yb), (xa, xb) = ay.targets(y0, y0 + row["h"]), ax.targets(x0, x0 + row["w"])
                high, wide, numbers = out_size * ky, out_size * kx, [row[c] for c in _AXES]
                for ty in range(ya // high, -(-yb // high)):
                    sa, sb = ay.sources(ty * high, min((ty + 1) * high, ay.n_target))
                    sa, sb = max(sa, y0), min(sb, y0 + row["h"])
                    for tx in range(xa // wide, -(-xb // wide)):
                        ca, cb = ax.sources(tx * wide, min((tx + 1) * wide, ax.n_target))
                        ca, cb = max(ca, x0), min(cb, x0 + row["w"])
                        if sa < sb and ca < cb:
                            yield ((rid, row["band"], ty, tx, sa, ca, sb - sa, cb - ca, ky, kx, *numbers),
                                   block[sa - y0:sb - y0, ca - x0:cb - x0].ravel())

    def assemble(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rid, by, bx = (k.as_py() for k in key)
        bands = np.asarray(table.column("band"))
        ids = {c: [] for c in ("raster_id", "band", "ty", "tx", "h", "w", "rh", "rw")}
        rows, counts, found = [], [], {}
        for b in np.unique(bands):
            for (ty, tx), made in one(by, bx, table.filter(pa.array(bands == b))):
                found.setdefault((ty, tx), []).append((int(b), *made))
        for (ty, tx), layers in found.items():
            some = int(np.any([np.nan_to_num(v) != 0 for _, v, _, _ in layers], axis=0).sum()) if seen else 0
            for band, v, rh, rw in layers:
                for c, x in zip(ids, (rid, band, ty, tx, *v.shape, rh, rw)):
                    ids[c].append(x)
                rows.append(v.ravel())
                counts.append(some)
        packed = tile_table(ids, rows)
        return packed.append_column("seen", pa.array(counts, pa.int64())) if seen else packed

    def one(by: int, bx: int, table: pa.Table) -> Iterator[tuple]:
        """The block's tiles that a window reaches."""
        first = {c: table.column(c)[0].as_py() for c in ("ky", "kx", *_AXES)}
        ay, ax = _axes(first)
        high, wide = out_size * first["ky"], out_size * first["kx"]
        ys, xs = ((t * side, min((t + 1) * side, a.n_target)) for t, side, a in ((by, high, ay), (bx, wide, ax)))
        (ya, yb), (xa, xb) = ay.sources(*ys), ax.sources(*xs)
        block, sent = np.full((yb - ya, xb - xa), np.nan), np.zeros((yb - ya, xb - xa), bool)
        for sy, sx, sh, sw, flat in zip(*(table.column(c).to_pylist() for c in ("sy", "sx", "sh", "sw")), list_rows(table.column("data"))):
            block[sy - ya:sy - ya + sh, sx - xa:sx - xa + sw] = flat.reshape(sh, sw)
            sent[sy - ya:sy - ya + sh, sx - xa:sx - xa + sw] = True
        wy, wx, there = ay.weights(ys, (ya, yb)), ax.weights(xs, (xa, xb)), ~np.isnan(block)
        mass = wy @ there.astype(float) @ wx.T
        value = wy @ np.where(there, block, 0.0) @ wx.T
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(mass > 0, value / mass, np.nan)
        for y in range(*ys, out_size):
            y1 = min(y + out_size, ys[1])
            sa, sb = ay.sources(y, y1)
            for x in range(*xs, out_size):
                x1 = min(x + out_size, xs[1])
                ca, cb = ax.sources(x, x1)
                if sent[sa - ya:sb - ya, ca - xa:cb - xa].any():
                    yield (y // out_size, x // out_size), (out[y - ys[0]:y1 - ys[0], x - xs[0]:x1 - xs[0]], ay.n_target, ax.n_target)

    windows = tile_batches(placed).select("raster_id", "band", "ty", "tx", "h", "w", "ky", "kx", *_AXES, "data").mapInArrow(
        lambda batches: strip_batches(cut(batches), _WINDOW), _WINDOW_SCHEMA)
    schema = TILE_SCHEMA + (", seen bigint" if seen else "")
    make = lambda w: w.groupBy("raster_id", "ty", "tx").applyInArrow(assemble, schema)
    if wanted is None:
        return make(windows)
    grid = F.col("raster_id") if home is None else F.col("grid_id")
    of = lambda d: (d if home is None else lookup_join(d, home.select("raster_id", "grid_id"), "raster_id", "inner")).withColumn("_grid", grid)
    tiles_in = wanted.select(F.col("raster_id").alias("_grid"), "ty", "tx")
    blocks = tiles_in.join(freeze(of(pairs).select("_grid", "ky", "kx").distinct()), "_grid").select(
        "_grid", "ky", "kx", F.expr("ty div ky").cast("int").alias("ty"), F.expr("tx div kx").cast("int").alias("tx"))
    needed = of(windows).join(blocks, ["_grid", "ky", "kx", "ty", "tx"], "left_semi").select(*_WINDOW.names)
    kept = of(make(needed)).join(tiles_in, ["_grid", "ty", "tx"], "left_semi")
    return kept.select(*[c.split()[0] for c in schema.split(", ")])


def complete(tiles: DataFrame, meta: DataFrame, size: int, bands: tuple[int, ...] = (1,)) -> DataFrame:
    """The tiles with the grid's other tiles added, all missing; a join per tile."""
    h, w = F.expr(f"least({size}, rh - ty * {size})"), F.expr(f"least({size}, rw - tx * {size})")
    grid = tile_grid(meta, size, bands).withColumn("band", F.col("band").cast("int"))
    blank = F.array_repeat(F.lit(None).cast("double"), h * w)
    key = ["raster_id", "band", "ty", "tx"]
    extra = [c for c in tiles.columns if c not in (*key, "h", "w", "rh", "rw", "data")]
    return grid.join(tiles.select(*key, "data", *extra), key, "left").select(
        *key, h.alias("h"), w.alias("w"), "rh", "rw", F.coalesce("data", blank).alias("data"), *extra)


def resample_image_tiles(tiles: DataFrame, bands: list[int], source: DataFrame, target: DataFrame, size: int, out_size: int,
                         top: float = 65535.0, wanted: DataFrame | None = None) -> DataFrame:
    """The tile form of :func:`resample_image`, with the column ``seen``; with ``wanted``, only the
    tiles listed there."""
    moved = resample_tiles(select_bands(tiles, bands), source, target, size, out_size, wanted, seen=True)
    return unit_image(moved, target, len(bands), out_size, top, wanted)


def unit_image(moved: DataFrame, target: DataFrame, n_bands: int, out_size: int, top: float = 65535.0,
               wanted: DataFrame | None = None) -> DataFrame:
    """Image tiles with the column ``seen`` on all tiles of the grid (or those wanted), scaled to [0, 1]; missing is 0."""
    full = complete(moved, target, out_size, tuple(range(1, n_bands + 1)))
    if wanted is not None:
        full = full.join(wanted.select("raster_id", "ty", "tx"), ["raster_id", "ty", "tx"], "left_semi")
    names = [c.split()[0] for c in TILE_SCHEMA.split(", ")]
    scaled = full.withColumns({"data": F.transform("data", lambda v: scale_to_unit(v, top)), "seen": F.coalesce("seen", F.lit(0))})
    return scaled.select(*names, "seen")
