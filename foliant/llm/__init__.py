"""Operators for training-data corpora: deduplication, mixing, archives, token files, scoring, filters, packing and media."""
