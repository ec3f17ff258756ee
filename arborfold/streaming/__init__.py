"""Structured Streaming over event and page streams."""
