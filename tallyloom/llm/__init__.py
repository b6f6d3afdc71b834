"""Operators of a training-data pipeline: scoring, extraction, deduplication, filtering, packing, sharding.

Nothing outside this package imports it.
"""
