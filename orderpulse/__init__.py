"""Purchase-behaviour analytics on Spark DataFrames."""
