"""Document-intake analytics on Spark DataFrames."""
