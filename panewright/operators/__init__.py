"""Data preparation on DataFrames: malformed rows, mixed timestamps, trailing periods and skewed keys."""
