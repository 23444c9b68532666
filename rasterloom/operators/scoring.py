"""User-function surface: batch scoring of patches and caller-supplied tile kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.pointwise import sigmoid
from rasterloom.model import NODATA, list_column, list_rows
from rasterloom.operators.tiles import map_tiles  # noqa: F401  (public: caller-supplied kernels)

LOGIT_SCHEMA = "patch_id string, logits array<double>"
_LOGIT_ARROW = pa.schema([("patch_id", pa.string()), ("logits", pa.list_(pa.float64()))])


def gather_channels(patches: DataFrame, channels: int) -> DataFrame:
    """Channels 0 to ``channels - 1`` of a patch in one row, channel-major (bounded by channels x size
    squared). A channel that the patch lacks is all missing (NULL); a patch without any channel is left out."""
    blank = F.array_repeat(F.lit(None).cast("double"), (F.col("size") * F.col("size")).cast("int"))
    stored = patches.filter(F.col("data").isNotNull() & F.col("channel").between(0, channels - 1))
    found = stored.groupBy("patch_id", "size").agg(F.collect_list(F.struct("channel", "data")).alias("found"))
    one = lambda c: F.coalesce(F.get(F.filter("found", lambda s: s["channel"] == c), F.lit(0))["data"], blank)
    return found.select("patch_id", "size", F.concat(*[one(c) for c in range(channels)]).alias("stack"))


def score_patches(patches: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]],
                  channels: int = 5) -> DataFrame:
    """Run a caller's model over patches. ``load`` is called once per partition and returns a
    function from ``(batch, channels, size, size)`` to logits ``(batch, size, size)``. Channels that a
    patch lacks reach it as NaN, and NaN logits are returned as NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            size = batch.column("size")[0].as_py()
            stack = np.stack(list_rows(batch.column("stack"))).reshape(-1, channels, size, size)
            logits = np.asarray(model(stack), dtype=float).reshape(len(stack), -1)
            yield pa.RecordBatch.from_arrays([batch.column("patch_id"), list_column(list(logits))], schema=_LOGIT_ARROW)

    return gather_channels(patches, channels).select("patch_id", "size", "stack").mapInArrow(run, LOGIT_SCHEMA)


def prediction_table(logits: DataFrame, masks: DataFrame, assignment: DataFrame) -> DataFrame:
    """Pixel-level predictions: logits zipped with the mask array of the same patch, with split and
    batch. ``masks``: patch_id, size, data; ``assignment``: patch_id, split, batch_id. The join is
    per patch; unpacking is narrow."""
    joined = logits.join(masks.select("patch_id", "size", "data"), "patch_id").join(assignment, "patch_id")
    flat = joined.select("split", "batch_id", "patch_id", "size", F.posexplode(F.arrays_zip("logits", "data")).alias("p", "c"))
    return flat.select(
        "split", "batch_id", "patch_id", F.expr("cast(p div size as int)").alias("y"),
        F.expr("cast(p % size as int)").alias("x"), F.col("c.logits").alias("logit"), F.col("c.data").alias("target"))


def pseudo_rgb(features: DataFrame, preds: DataFrame) -> DataFrame:
    """Display table per patch pixel: three stretched channels, target and prediction with the
    sentinel hidden, and the unmasked prediction. ``features``: patch_id, channel, y, x, v."""
    colours = features.filter(F.col("channel").isin(0, 1, 2))
    ends = colours.groupBy("patch_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("v")))
    rgb = features.groupBy("patch_id", "y", "x").agg(
        pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), pick(4).alias("ndsm"))
    stretched = rgb.join(ends, "patch_id").withColumns(
        {c: (F.col(c) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8) for c in ("r", "g", "b")}).drop("_lo", "_hi")
    shown = F.col("target") != NODATA
    p = preds.select("patch_id", "y", "x", F.when(shown, F.col("target")).alias("gt"),
                     F.when(shown, sigmoid(F.col("logit"))).alias("pred_masked"), sigmoid(F.col("logit")).alias("pred"))
    return stretched.join(p, ["patch_id", "y", "x"])
