"""Streaming of blockloom."""
