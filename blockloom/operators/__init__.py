"""Operators of blockloom."""
