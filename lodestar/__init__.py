"""Lodestar: analytics operators for PySpark, each a function from DataFrames to DataFrames."""
