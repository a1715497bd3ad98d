"""Operators that prepare large text collections: filters, scans, deduplication, mixing, sharding, search."""
