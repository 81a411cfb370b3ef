"""Analytics over linked document collections, as Spark DataFrames."""
