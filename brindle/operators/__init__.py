"""Bulk jobs: DataFrames in, DataFrames out."""
