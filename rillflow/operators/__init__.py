"""Operators on weighted tables."""
