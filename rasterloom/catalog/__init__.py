"""Queries over the test tables with their SQL counterparts."""

from rasterloom.catalog import patchsets, rasters, runs, scores, vectors  # noqa: F401
from rasterloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
