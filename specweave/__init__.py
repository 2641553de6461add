"""Document and RTL knowledge-graph analytics on Spark DataFrames."""
