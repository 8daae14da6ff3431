"""Batches as they land, change logs and files."""
