"""Operators of a training-data pipeline: deduplication, tokenisation, filtering, packing.

Nothing outside this package imports it.
"""
