"""Price-gap analytics on Spark DataFrames."""
