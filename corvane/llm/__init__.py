"""Operators of a training-data pipeline: deduplication, filtering, packing, archives.

Nothing outside this folder imports it.
"""
