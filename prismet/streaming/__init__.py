"""Structured Streaming forms of the ordered analytics."""
