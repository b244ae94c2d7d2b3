"""Operators for large text corpora: derivatives, deduplication, filters, mixing, packing and exact search."""
