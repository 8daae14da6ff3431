"""Consolidation of records from many sources into entities, and the analytics on top, on Spark."""
