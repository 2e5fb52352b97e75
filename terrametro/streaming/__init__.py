"""Incremental collection as Structured Streaming jobs."""
