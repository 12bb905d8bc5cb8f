"""factloom: an evidence-graph engine on Spark DataFrames."""
