"""Context retrieval and analytics on Spark DataFrames."""
