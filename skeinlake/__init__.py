"""Retrieval analytics on Spark: chunking, graphs, communities, vector and full-text search."""

__version__ = "0.1.0"
