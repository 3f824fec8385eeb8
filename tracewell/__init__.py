"""Text provenance and policy analytics on Spark DataFrames."""
