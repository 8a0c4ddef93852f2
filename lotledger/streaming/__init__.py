"""Structured Streaming jobs over the same transformations as the batch ones."""
