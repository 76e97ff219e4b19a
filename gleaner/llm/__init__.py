"""Operators for building training corpora: quality rules, deduplication, packing, archives, scores, privacy."""
