"""Structured Streaming jobs; their transformations also run on batch tables."""
