"""Functions of blockloom."""
