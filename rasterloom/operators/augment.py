"""Training augmentation of patches.

All randomness is drawn once per stored array (one row per patch and channel) by
:func:`with_draws`, as a struct of Column expressions that depend only on (seed, epoch, patch,
operation): a retried task gives the same rows, and nothing is hashed per pixel. The draws feed

* the pixel form: projections over ``patch_id, channel, size, draw, y, x, v`` - no shuffle, except
  for the blur, whose pixels meet their neighbours in one aggregation;
* the array form (:func:`augment`): one narrow Arrow pass with a few numpy lines per operation,
  the choice for whole training sets.

The mask travels as channel -1: geometric operations move it, all others leave it alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import kernels
from rasterloom.functions.hashing import LEHMER_A, LEHMER_M, between, key31, pixel_state, step, uniform, unit
from rasterloom.functions.pointwise import clamp
from rasterloom.model import list_column, list_rows
from rasterloom.operators.focal import spread

MASK_CHANNEL = -1


@dataclass(frozen=True)
class Ranges:
    """Fixed values of the training recipe: probabilities and ranges."""

    flip: float = 0.5
    rotate: float = 0.5
    transpose: float = 0.5
    distort: float = 0.2
    distort_steps: int = 5
    distort_limit: float = 0.1
    tone: float = 0.4
    tone_limit: float = 0.15
    gamma: float = 0.3
    gamma_range: tuple[float, float] = (0.85, 1.15)
    gain: float = 0.3
    gain_range: tuple[float, float] = (0.92, 1.08)
    noise: float = 0.3
    noise_range: tuple[float, float] = (0.005, 0.02)
    blur: float = 0.2
    dropout: float = 0.2
    holes: tuple[int, int] = (1, 4)
    hole_size: tuple[int, int] = (32, 96)


def blur_sigma(radius: int) -> float:
    """Fixed rule: the standard deviation belonging to an odd kernel size."""
    return 0.3 * (radius - 1) + 0.8


def with_draws(patches: DataFrame, epoch: int, seed: int, ranges: Ranges = Ranges()) -> DataFrame:
    """Add the struct ``draw``. Apply to stored arrays, before they are unpacked."""
    g, pid, size = ranges, F.col("patch_id"), F.col("size")
    u = lambda *op: uniform(seed, epoch, pid, *op)
    span = lambda lo, hi, *op: between(lo, hi, seed, epoch, pid, *op)
    on = lambda op, p: u(op) < p

    def hole(i: int) -> Column:
        lo, hi = g.hole_size
        extent = lambda op: F.when(size >= hi, lo + F.floor(span(0, hi - lo + 1, op, i))).otherwise(
            F.raise_error(F.lit(f"occlusions of up to {hi} cells need patches of at least that side")).cast("bigint"))
        h, w = extent("hole_h"), extent("hole_w")
        top, left = F.floor(u("hole_y", i) * (size - h + 1)), F.floor(u("hole_x", i) * (size - w + 1))
        return F.struct(top.alias("y0"), (top + h).alias("y1"), left.alias("x0"), (left + w).alias("x1"))

    n_holes = g.holes[0] + F.floor(span(0, g.holes[1] - g.holes[0] + 1, "hole_count")).cast("int")
    stretch = lambda axis: F.array(*[
        1.0 + span(-g.distort_limit, g.distort_limit, f"stretch_{axis}", i) for i in range(g.distort_steps)])
    fields = {
        "flip_h": on("flip_h", g.flip),
        "flip_v": on("flip_v", g.flip),
        "turns": F.when(on("rotate", g.rotate), F.floor(span(0, 4, "turns")).cast("int")).otherwise(0),
        "transpose": on("transpose", g.transpose),
        "distort": on("distort", g.distort),
        "stretch_y": stretch("y"),
        "stretch_x": stretch("x"),
        "tone": on("tone", g.tone),
        "contrast": span(-g.tone_limit, g.tone_limit, "contrast"),
        "brightness": span(-g.tone_limit, g.tone_limit, "brightness"),
        "gamma": on("gamma", g.gamma),
        "gamma_value": span(*g.gamma_range, "gamma_value"),
        "gain": on("gain", g.gain),
        "gain_value": span(*g.gain_range, "gain_value", F.col("channel")),
        "noise": on("noise", g.noise),
        "noise_sd": span(*g.noise_range, "noise_sd"),
        "noise_key": key31(seed, epoch, pid, "noise_key", F.col("channel")),
        "blur": F.when(on("blur", g.blur), F.when(u("blur_size") < 0.5, 1).otherwise(2)).otherwise(0),
        "holes": F.when(on("dropout", g.dropout), F.slice(F.array(*[hole(i) for i in range(g.holes[1])]), 1, n_holes)),
    }
    return patches.withColumn("draw", F.struct(*[c.alias(n) for n, c in fields.items()]))


# pixel form -------------------------------------------------------------------------------------
def _on_image(new: Column) -> Column:
    return F.when(F.col("channel") != MASK_CHANNEL, new).otherwise(F.col("v"))


def _when_drawn(op: str, new: Column) -> Column:
    return _on_image(F.when(F.col(f"draw.{op}"), new).otherwise(F.col("v")))


def flip(px: DataFrame) -> DataFrame:
    last, y, x = F.col("size") - 1, F.col("y"), F.col("x")
    return px.withColumns({"y": F.when(F.col("draw.flip_v"), last - y).otherwise(y),
                           "x": F.when(F.col("draw.flip_h"), last - x).otherwise(x)})


def turn(px: DataFrame) -> DataFrame:
    """Counter-clockwise quarter turns, then the transpose; with :func:`flip` every square symmetry."""
    last, y, x, k = F.col("size") - 1, F.col("y"), F.col("x"), F.col("draw.turns")
    ty = F.when(k == 0, y).when(k == 1, last - x).when(k == 2, last - y).otherwise(x)
    tx = F.when(k == 0, x).when(k == 1, y).when(k == 2, last - x).otherwise(last - y)
    t = F.col("draw.transpose")
    return px.withColumns({"y": F.when(t, tx).otherwise(ty), "x": F.when(t, ty).otherwise(tx)})


def tone(px: DataFrame) -> DataFrame:
    v = F.col("v") * (1.0 + F.col("draw.contrast")) + F.col("draw.brightness")
    return px.withColumn("v", _when_drawn("tone", clamp(v, 0.0, 1.0)))


def gamma(px: DataFrame) -> DataFrame:
    return px.withColumn("v", _when_drawn("gamma", F.pow(F.greatest(F.col("v"), F.lit(0.0)), F.col("draw.gamma_value"))))


def gain(px: DataFrame) -> DataFrame:
    return px.withColumn("v", _when_drawn("gain", F.col("v") * F.col("draw.gain_value")))


def noise(px: DataFrame) -> DataFrame:
    """Box-Muller from two integer draws per pixel."""
    position = (F.col("y") * F.col("size") + F.col("x")).cast("bigint")
    first = step(pixel_state(F.col("draw.noise_key"), position), 3)
    normal = F.sqrt(-2.0 * F.ln(unit(first))) * F.cos(2.0 * np.pi * unit(step(first, 3)))
    return px.withColumn("v", _when_drawn("noise", F.col("v") + F.col("draw.noise_sd") * normal))


def dropout(px: DataFrame) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    inside = F.exists("draw.holes", lambda h: (y >= h["y0"]) & (y < h["y1"]) & (x >= h["x0"]) & (x < h["x1"]))
    return px.withColumn("v", _on_image(F.when(inside, 0.0).otherwise(F.col("v"))))


def blur(px: DataFrame) -> DataFrame:
    """Both kernel sizes in one pair of passes, the row's own one taken at the end; untouched patches
    pass through."""
    keep = [c for c in px.columns if c != "draw"]
    marked = px.withColumn("_r", F.when(F.col("channel") == MASK_CHANNEL, 0).otherwise(F.col("draw.blur")))
    keys = ["patch_id", "channel", "size", "_r"]
    weights = {f"_v{r}": [0.0] * (2 - r) + list(kernels.gaussian_weights(blur_sigma(r), r)) + [0.0] * (2 - r) for r in (1, 2)}
    part = marked.filter("_r > 0").select(*keys, F.col("size").alias("height"), F.col("size").alias("width"), "y", "x", "v")
    both = spread(spread(part, "y", "height", weights, keys), "x", "width", weights, keys)
    chosen = both.withColumn("v", F.when(F.col("_r") == 1, F.col("_v1")).otherwise(F.col("_v2")))
    out = marked.filter("_r = 0").select(*keep).unionByName(chosen.select(*keep))
    return out


# array form -------------------------------------------------------------------------------------
def _augment_array(a: np.ndarray, d: dict, is_mask: bool) -> np.ndarray:
    size = len(a)
    a = a[::-1] if d["flip_v"] else a
    a = a[:, ::-1] if d["flip_h"] else a
    a = np.rot90(a, d["turns"])
    a = a.T if d["transpose"] else a
    if d["distort"]:
        a = kernels.distort(a, kernels.grid_map(size, d["stretch_y"]), kernels.grid_map(size, d["stretch_x"]), is_mask)
    if is_mask:
        return a
    if d["tone"]:
        a = np.clip(a * (1.0 + d["contrast"]) + d["brightness"], 0.0, 1.0)
    if d["gamma"]:
        a = np.maximum(a, 0.0) ** d["gamma_value"]
    if d["gain"]:
        a = a * d["gain_value"]
    if d["noise"]:
        state = (d["noise_key"] + np.arange(size * size, dtype=np.int64) * 40014) % (LEHMER_M - 1) + 1
        draws = []
        for _ in range(2):
            for _ in range(3):
                state = state * LEHMER_A % LEHMER_M
            draws.append(state / float(LEHMER_M))
        normal = np.sqrt(-2.0 * np.log(draws[0])) * np.cos(2.0 * np.pi * draws[1])
        a = a + d["noise_sd"] * normal.reshape(size, size)
    if d["blur"]:
        r = d["blur"]
        a = kernels.blur_block(np.pad(a, r, mode="symmetric"), kernels.gaussian_weights(blur_sigma(r), r))
    if d["holes"]:
        a = a.copy()
        for h in d["holes"]:
            a[h["y0"]:h["y1"], h["x0"]:h["x1"]] = 0.0
    return a


def apply_draws(drawn: DataFrame) -> DataFrame:
    """Apply the struct ``draw`` to the arrays of its row; narrow, one Arrow pass."""
    names = [c for c in drawn.columns if c != "draw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws, channels, sizes = (batch.column(c).to_pylist() for c in ("draw", "channel", "size"))
            rows = [
                _augment_array(flat.reshape(s, s), d, c == MASK_CHANNEL).ravel()
                for flat, d, c, s in zip(list_rows(batch.column("data")), draws, channels, sizes)]
            cols = [list_column(rows) if n == "data" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return drawn.mapInArrow(run, drawn.select(*names).schema)


def augment(patches: DataFrame, epoch: int, seed: int, ranges: Ranges = Ranges(), enabled: bool = True) -> DataFrame:
    """The whole chain: geometric, radiometric, occlusion. ``enabled=False`` passes patches through."""
    return apply_draws(with_draws(patches, epoch, seed, ranges)) if enabled else patches
