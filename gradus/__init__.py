"""Answer analytics on Spark DataFrames."""
