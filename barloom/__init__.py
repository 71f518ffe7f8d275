"""Ordered-series analytics on Spark DataFrames."""
