"""Operators for preparing training text: scoring, filtering, deduplication, tokens, packing."""
