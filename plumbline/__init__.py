"""Plumbline: profiling, trend, document and grid analytics on Spark DataFrames."""
