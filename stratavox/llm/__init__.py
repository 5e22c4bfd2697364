"""Operators for training-data corpora: quality, extraction, decontamination, privacy, toxicity, deduplication and tokens."""
