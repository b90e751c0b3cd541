"""Operators for preparing training text: each in its own module, over Spark DataFrames."""
