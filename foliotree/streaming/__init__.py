"""Structured Streaming versions of indexing and of the answer stream."""
