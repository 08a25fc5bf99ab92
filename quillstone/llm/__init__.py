"""Training-data operators: deduplication, scoring, extraction, mixing and packing of text corpora.

Nothing outside this subpackage imports it.
"""
