"""Surface analytics on Spark DataFrames."""
