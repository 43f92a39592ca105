"""Operators for preparing text corpora: duplicates, secrets, quality, tokens."""
