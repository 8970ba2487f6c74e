"""Operators over query corpora, semantic-model fields and tables."""
