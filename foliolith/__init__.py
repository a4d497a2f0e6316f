"""Spark-first engine for checking, comparing and curating large document batches."""
