"""Sparse-matrix dataflow, partitioning and benchmark analytics on Spark DataFrames."""
