"""Data-validation checks, run history and quality reports on Spark DataFrames."""
