"""petrel: web-archive analytics on Spark DataFrames."""
