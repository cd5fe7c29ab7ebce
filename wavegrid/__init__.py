"""wavegrid: trace analytics on Spark DataFrames."""
