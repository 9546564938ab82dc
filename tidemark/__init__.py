"""tidemark: timeline analytics on Spark DataFrames."""
