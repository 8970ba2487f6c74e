"""Training-data operators: deduplication, tokenization, search, scoring and formatting over Spark DataFrames."""
