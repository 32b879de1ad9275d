"""Operators for training corpora: scoring, filtering, mixing, de-duplication, search and tokens."""
