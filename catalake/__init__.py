"""Catalog data quality and batch loading on Spark: DataFrames in, DataFrames out."""
