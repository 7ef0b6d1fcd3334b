"""Operators for preparing training data: deduplication, filters, search, mixing and packing."""
