"""Incremental updates, as batches and as streams."""
