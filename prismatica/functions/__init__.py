"""Column functions: naming, timeframes, filter texts, SQL text."""
