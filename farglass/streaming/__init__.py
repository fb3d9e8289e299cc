"""Streaming forms of the batch aggregations."""
