"""String columns: run names, experiment ids, patch names and file-name classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts used by the file layout.
MASK_TAG = "_mask"
SURFACE_TAG = "_dsm"
IMAGE_TAG = "_ms4"
RASTER_EXT = ".tif"
LOSS_TERMS = ("bce", "dice", "iou", "mae")


def with_suffix(path: Column, suffix: Column) -> Column:
    """Insert ``suffix`` before the extension of the last path part."""
    ext = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(ext))
    return F.concat(stem, suffix, ext)


def short_number(v: Column) -> Column:
    """At most six decimals without trailing zeros, as a config value prints (0.3, 2, 1.25)."""
    text = F.call_function("format_number", v.cast("double"), F.lit("0.######"))
    return F.regexp_replace(text, r"\.$", "")


def float_text(v: Column) -> Column:
    """A float with at least one decimal (2.0, 1.3)."""
    return F.call_function("format_number", v.cast("double"), F.lit("0.0#####"))


def run_name(method: Column, combine: Column, windows: Column, height: Column, sigma: Column,
             has_dtm: Column) -> Column:
    """The parameter tag of a ground-masking run."""
    low = F.concat(F.lit("_lm_w"), F.array_join(windows.cast("array<string>"), "-"), F.lit("_ht"), float_text(height))
    ext = F.concat(F.lit("_dtm_ht"), float_text(height))
    slope = F.concat(F.lit("_gr_s"), float_text(sigma))
    return (
        F.when(method == "local_min", low)
        .when(method == "dtm", ext)
        .when(method == "gradient", slope)
        .otherwise(F.concat(F.when(has_dtm, ext).otherwise(low), slope, F.lit("_"), combine))
    )


def experiment_id(model: Column, weights: Column, losses: dict[str, Column], tag: Column) -> Column:
    """``model__weights__loss terms__tag``; absent parts and zero-weight terms are left out."""
    base = F.regexp_extract(weights, r"([^/\\]+)$", 1)
    looks_like_path = weights.contains("/") | weights.contains("\\")
    stem = F.when(looks_like_path, F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).otherwise(weights)
    terms = F.concat_ws("_", *[
        F.when(losses[t] > 0, F.concat(F.lit(t), short_number(losses[t]))) for t in LOSS_TERMS if t in losses
    ])
    empty_to_null = lambda c: F.when(c != "", c)
    return F.concat_ws("__", model, empty_to_null(stem), empty_to_null(terms), empty_to_null(tag))


def patch_name(row: Column, col: Column, n_rows: Column, n_cols: Column) -> Column:
    """Zero-padded ``<row>_<col>_ms4``; the widths come from the counts, not the largest index."""
    pad = lambda i, n: F.lpad(i.cast("string"), F.length(n.cast("string")), F.lit("0"))
    return F.concat(pad(row, n_rows), F.lit("_"), pad(col, n_cols), F.lit(IMAGE_TAG))


def file_kind(path: Column) -> Column:
    """mask, dsm or image, by the tags inside the file stem; NULL for other extensions."""
    stem = file_stem(path)
    return F.when(
        path.endswith(RASTER_EXT),
        F.when(stem.contains(MASK_TAG), F.lit("mask")).when(stem.contains(SURFACE_TAG), F.lit("dsm")).otherwise("image"),
    )


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def triple_stem(path: Column) -> Column:
    """The image stem a mask or surface file belongs to (its tag as the final part is dropped)."""
    return F.regexp_replace(file_stem(path), f"({MASK_TAG}|{SURFACE_TAG})$", "")


def patch_position(stem: Column) -> tuple[Column, Column]:
    """Row and column parsed back from a patch name."""
    part = lambda k: F.regexp_extract(stem, r"^(\d+)_(\d+)" + IMAGE_TAG, k)
    as_int = lambda c: F.when(c != "", c.cast("int"))
    return as_int(part(1)), as_int(part(2))
