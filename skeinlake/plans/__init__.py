"""Queries registered with the driver, and the facade over indexers and retrievers."""
