"""Keyed event state and incremental ingest with Structured Streaming."""
