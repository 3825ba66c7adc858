"""Structured Streaming forms of the link operators."""
