"""Streaming of the document privacy engine."""
