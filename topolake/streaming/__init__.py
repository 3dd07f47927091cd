"""Streaming variants of the sources."""
