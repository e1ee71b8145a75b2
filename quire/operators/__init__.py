"""Operators over the library's tables: DataFrames in, DataFrames out."""
