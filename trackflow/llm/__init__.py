"""Operators for preparing training text: dedup, language, quality, mixing, extraction, search, tokenizing."""
