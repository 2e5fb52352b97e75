"""Readers, schema contracts and sinks."""
