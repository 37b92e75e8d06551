"""Operators of a training-data pipeline: filtering, scoring, near-duplicates, mixing and tokenizing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
