"""Raster, patch and prediction analytics on PySpark DataFrames."""
