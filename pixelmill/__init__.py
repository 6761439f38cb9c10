"""Raster and segment analytics on Spark DataFrames."""
