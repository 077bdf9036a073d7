"""Operators of a training-data pipeline: counting, cleaning, de-duplicating, scanning and packing documents.

Each module holds one operator; ``queries`` registers them over the given tables.
"""
