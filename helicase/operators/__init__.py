"""Relational operators: DataFrames in, DataFrame out."""
