"""Readers of files and tables, and table sinks."""
