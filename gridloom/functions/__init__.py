"""Coordinate arithmetic as Python values and Spark columns."""
