"""Connected-vehicle analytics on Spark DataFrames."""
