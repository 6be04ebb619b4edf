"""tessera: annotated-corpus analytics on Spark DataFrames."""
