"""Operators for preparing training text at scale, each a function from DataFrames to a DataFrame."""
