"""News and event intelligence on Spark DataFrames."""
