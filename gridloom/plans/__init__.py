"""Query settings and split planning."""
