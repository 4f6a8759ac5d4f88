"""Incremental ingest and continuous usage queries."""
