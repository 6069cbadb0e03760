"""Incremental runners over a folder of arriving sentence files (Structured Streaming)."""
