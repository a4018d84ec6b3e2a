"""Operators for building training data: deduplication, filters, scans, tokens, archives, search.

Nothing outside this package (and `corpus_pipeline.py`, which belongs to it) imports it.
"""
