"""Keeping an index up to date from a stream of file events."""
