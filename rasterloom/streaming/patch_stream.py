"""Quality control of patches as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.naming import patch_position
from rasterloom.model import NODATA
from rasterloom.operators.patches import qc_filter


def check_arrivals(patches: DataFrame, nodata_threshold: float, image_threshold: float) -> DataFrame:
    """Stateless: a row holds the whole patch (``name``, ``mask`` array, ``bands`` array of arrays).

    Adds row, column, both fractions and the status of the quality filter.
    """
    area = F.size("mask")
    places = F.sequence(F.lit(1), area)
    blank = F.filter(places, lambda i: F.forall("bands", lambda b: F.element_at(b, i) == 0))
    row, col = patch_position(F.col("name"))
    fractions = patches.select(
        "name", row.alias("pr"), col.alias("pc"),
        (F.size(F.filter("mask", lambda v: v == NODATA)) / area).alias("mask_nodata"),
        (F.size(blank) / area).alias("image_zero"))
    return qc_filter(fractions, nodata_threshold, image_threshold)


def start_ingest(arrivals: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Append the checked patches to a Parquet table."""
    writer = arrivals.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
