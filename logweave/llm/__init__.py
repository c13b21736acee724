"""Operators for training-data pipelines: dedup, filtering, tokenisation, extraction and search."""
