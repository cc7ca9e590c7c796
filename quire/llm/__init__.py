"""Operators of a training-data pipeline: packing, filters, de-duplication, tokenising, extraction.

Nothing else in the library imports this subpackage.
"""
