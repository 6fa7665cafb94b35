"""quire: document-graph analytics on Spark DataFrames."""
