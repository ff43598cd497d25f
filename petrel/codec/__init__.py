"""Byte-level codecs; plain Python, no Spark."""
