"""Operators over DataFrames. Each takes its columns by name and returns a DataFrame; none collects rows."""
