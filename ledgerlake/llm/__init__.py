"""Operators for preparing training data: dedup, archives, secret scans, tokens, quality, search, extraction, packing."""
