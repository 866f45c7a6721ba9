"""Operators for preparing training data: tokenising, deduplication, filtering, formatting and packing."""
