"""Operators for preparing training data from transcripts, corpora and evaluation runs.

Nothing outside this package imports it.
"""
