"""Training-data operators: dedup, mixing, sharding, filters and formatting.

Nothing outside this package imports it.
"""
