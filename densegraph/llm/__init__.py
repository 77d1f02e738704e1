"""Operators for large text corpora: quality, secrets, duplicates, tokens, pages.

Nothing else in the library imports this subpackage.
"""
