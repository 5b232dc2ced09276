"""Lintel: text and package hygiene, and training-data preparation, on Spark."""
