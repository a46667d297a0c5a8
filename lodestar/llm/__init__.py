"""Operators for training-data pipelines: each takes DataFrames and returns DataFrames."""
