"""Domains of the analysis and column functions over them."""
