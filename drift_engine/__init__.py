"""drift_engine: trajectory transition matrices, ridges and fronts on Spark DataFrames."""

__version__ = "0.1.0"
