"""Hybrid retrieval analytics on Spark DataFrames."""
