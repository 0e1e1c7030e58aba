"""Structured Streaming: incremental genome ingest (ST1)."""
