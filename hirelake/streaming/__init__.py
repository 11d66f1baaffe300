"""Structured Streaming twins."""
