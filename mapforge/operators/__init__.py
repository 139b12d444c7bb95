"""Operators on detector data: DataFrames in, a DataFrame out, with the key columns as parameters."""
