"""Operators over vector tables: DataFrames in, DataFrames out."""
