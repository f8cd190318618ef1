"""Operators for preparing text corpora: deduplication, quality, language, archives, secrets, tokens, mixing."""
