"""Operators of the document privacy engine."""
