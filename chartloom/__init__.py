"""Chart analytics and hybrid retrieval on Spark DataFrames."""
