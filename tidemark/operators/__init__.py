"""Relational operators: pure functions from DataFrames to DataFrames; clocks are arguments."""
