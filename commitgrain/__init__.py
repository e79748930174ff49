"""Change-risk analytics on Spark DataFrames."""
