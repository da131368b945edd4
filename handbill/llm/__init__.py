"""Operators for large text corpora: cleaning, deduplication, mixing and tokenising."""
