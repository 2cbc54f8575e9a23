"""Explain why a business metric moved, for every slice at once, on Spark DataFrames."""

__version__ = "0.1.0"
