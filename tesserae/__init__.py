"""Raster-to-vector analytics on Spark: pixels, tiles, components and features as DataFrames."""

__version__ = "0.1.0"
