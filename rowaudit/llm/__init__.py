"""Operators for large text corpora: deduplication, scanning, scoring, tokenising and packing.

Nothing else in the library imports this subpackage.
"""
