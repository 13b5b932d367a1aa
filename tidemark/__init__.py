"""tidemark: time-series research and training-data operators on Spark DataFrames."""
