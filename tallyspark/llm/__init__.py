"""Operators for building training data: quality, privacy, near-duplicates, repeats, secrets, languages, contamination and mixing.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns DataFrames; columns it does not need
are ignored, so extra or clashing names never matter.
"""
