"""Analytics over asset libraries, on Spark DataFrames."""
