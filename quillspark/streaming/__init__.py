"""Structured Streaming twins of the batch state operators."""
