"""Content-addressed data processing on Spark DataFrames."""
