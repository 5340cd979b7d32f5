"""Structured Streaming over the change log."""
