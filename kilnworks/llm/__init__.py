"""Corpus-scale operators for training data: search, deduplication, mixing, packing, archives, scans and scoring."""
