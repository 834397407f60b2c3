"""Operators that prepare training data: search, classification, near-duplicates, mixing, scoring and tokens."""
