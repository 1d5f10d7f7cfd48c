"""corpusloom: graph-based retrieval over text collections as Spark DataFrames."""
