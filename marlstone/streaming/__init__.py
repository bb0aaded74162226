"""Structured Streaming over day files of posts."""
