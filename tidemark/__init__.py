"""Tidemark: environmental time series, pixel tables and river geometry as Spark DataFrames."""
