"""Lowering of logical operators to DataFrames, and graph algorithms."""
