"""Structured Streaming forms of ingest and channel windows."""
