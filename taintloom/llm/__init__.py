"""Operators for preparing training data: deduplication, extraction, tokenising, packing, scoring.

Nothing outside this subpackage imports it.
"""
