"""Batch analytics of transit networks on Spark DataFrames."""
