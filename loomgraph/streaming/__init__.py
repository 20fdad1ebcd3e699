"""Incremental ingest of file rows."""
