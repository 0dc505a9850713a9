"""A full-text identifier index and search engine expressed as Spark DataFrames."""
