"""Tidemark: incremental catalogue processing on Spark DataFrames."""
