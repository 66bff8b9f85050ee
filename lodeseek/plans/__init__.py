"""Whole queries: searches end to end, and the registry of named ones."""
