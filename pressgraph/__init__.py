"""Web-article analytics on Spark DataFrames."""
