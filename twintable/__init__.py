"""Profile, fabricate, constrain and score tables with Spark DataFrames."""

__version__ = "0.1.0"
