"""Media catalog, vector retrieval and evaluation analytics on Spark DataFrames."""
