"""Record linkage and data processing with Spark DataFrames."""
