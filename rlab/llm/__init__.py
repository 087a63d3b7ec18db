"""Corpus preparation for training data: deduplication, filtering, formatting, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
