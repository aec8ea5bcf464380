"""Interval and copy-ratio analytics over Spark DataFrames."""
