"""Structured Streaming pipelines over files of an archive as they arrive."""
