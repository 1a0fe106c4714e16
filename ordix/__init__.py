"""Ordered-index analytics on Spark DataFrames."""
