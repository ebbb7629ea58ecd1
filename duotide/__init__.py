"""Two-layer (speed + batch) stream forecasting analytics on Spark DataFrames."""

__version__ = "0.1.0"
