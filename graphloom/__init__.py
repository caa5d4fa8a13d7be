"""A graph-query and inference engine on Spark DataFrames."""
