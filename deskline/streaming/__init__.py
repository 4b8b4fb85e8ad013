"""Structured Streaming jobs over the batch transforms."""
