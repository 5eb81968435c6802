"""Training-data operators: filtering, deduplication, tokenisation, packing and media columns.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin driver queries.
"""
