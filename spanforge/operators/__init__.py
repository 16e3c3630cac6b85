"""Operators: DataFrames in, DataFrames out, keyed by window, stream or object."""
