"""Arrays, tiles, chunks and multi-file arrays."""
