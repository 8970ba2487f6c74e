"""Incremental forms of the corpus operators."""
