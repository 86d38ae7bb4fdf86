"""Document-plan analytics on Spark DataFrames."""
