"""Multilingual corpus and embedding-space analytics on Spark."""
