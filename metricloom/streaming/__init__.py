"""Structured Streaming jobs built from the table operators."""
