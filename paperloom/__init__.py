"""Publication analytics on Spark DataFrames."""
