"""Operators for training-data pipelines: dedup, filters, extraction, search, packing, scans.

Nothing else in the library imports this package.
"""
