"""Operators for building training corpora: scoring, deduplication, privacy, extraction and tokens."""
