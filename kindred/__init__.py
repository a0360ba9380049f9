"""Document-similarity graphs and corpus operators on Spark DataFrames."""
