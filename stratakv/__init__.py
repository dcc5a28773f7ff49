"""A versioned, ordered key-value engine on Spark DataFrames."""
