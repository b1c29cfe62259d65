"""Operators for preparing training text: tokenising, filtering, deduplication, packing and scoring."""
