"""Streams: annotations as they come in."""
