"""Streams of reading events."""
