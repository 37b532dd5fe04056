"""Structural diversity analytics and corpus processing, expressed as Spark DataFrames."""

__version__ = "0.1.0"
