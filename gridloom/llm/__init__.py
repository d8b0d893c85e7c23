"""Training-data operators: quality, privacy, extraction, deduplication and packing."""
