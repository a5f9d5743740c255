"""Analytics over captured retail-lending pages, on Spark DataFrames."""
