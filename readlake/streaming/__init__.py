"""Structured Streaming over read files."""
