"""Analytics operators for measurement tables, written for Spark DataFrames."""
