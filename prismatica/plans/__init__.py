"""Semantic models and the DataFrames that requests against them denote."""
