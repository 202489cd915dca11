"""Streams of memories."""
