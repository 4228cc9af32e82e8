"""quadloom: a knowledge-graph analytics engine whose plans are plain Spark DataFrames."""
