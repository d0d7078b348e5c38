"""Incremental maintenance of vector tables."""
