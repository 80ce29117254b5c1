"""Operators of a training-data pipeline: packing, counting, filtering, deduplication."""
