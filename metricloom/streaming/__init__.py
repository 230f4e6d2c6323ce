"""Structured Streaming jobs built from the same transforms as the batch queries."""
