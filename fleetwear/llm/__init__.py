"""Operators for training-data corpora: filtering, deduplication, scans and packing."""
