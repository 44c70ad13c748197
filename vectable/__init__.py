"""Vector, text and scalar table operators for Spark DataFrames."""
