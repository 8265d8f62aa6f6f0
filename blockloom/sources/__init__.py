"""Sources of blockloom."""
