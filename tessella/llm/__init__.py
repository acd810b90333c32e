"""Operators for building language-model training data: filtering, deduplication, packing, scoring and search."""
