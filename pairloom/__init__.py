"""Preference-data operators for Spark: DataFrames in, DataFrames out."""
