"""A semantic query and governance engine on Spark DataFrames."""
