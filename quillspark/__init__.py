"""Retrieval and document analytics as ordinary PySpark plans."""
