"""Structured Streaming forms of the log queries (an extension)."""
