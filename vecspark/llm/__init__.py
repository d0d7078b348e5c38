"""Operators for preparing text corpora: scanning, deduplication, mixing, scoring."""
