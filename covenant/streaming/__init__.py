"""Incremental runs as micro-batches."""
