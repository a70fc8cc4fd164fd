"""Source-code, manifest and text analytics on Spark DataFrames."""
