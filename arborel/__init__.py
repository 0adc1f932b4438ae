"""Hierarchical entity analytics on Spark DataFrames."""
