"""Resumable ingestion with Structured Streaming."""
