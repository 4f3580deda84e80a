"""Operators for preparing training data: deduplication, mixing, scoring, scanning and tokenising of documents."""
