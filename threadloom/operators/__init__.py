"""Operators: DataFrames in, a DataFrame out, nothing collected unless a docstring says so."""
