"""Corpus-scale document indexing, page retrieval and conversations on Spark."""
