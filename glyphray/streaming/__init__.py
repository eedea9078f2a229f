"""Structured Streaming jobs; the transforms are those of the batch operators."""
