"""Operators for large training-data pipelines (text scoring, dedup, packing).

Nothing else in the library imports this subpackage.
"""
