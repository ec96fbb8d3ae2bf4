"""Operators for preparing training data: scoring, deduplication, search, mixing, packing, scanning.

Nothing else in the package imports this subpackage. Each operator takes DataFrames and returns
a DataFrame; ``queries.py`` binds them to the benchmark tables.
"""
