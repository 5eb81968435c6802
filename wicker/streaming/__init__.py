"""Structured Streaming twins of the queue operators."""
