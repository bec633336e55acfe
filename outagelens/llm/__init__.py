"""Operators for training-data pipelines (deduplication, packing, scans, filters, archives).

Nothing else in the library imports this subpackage; ``queries.py`` lists the
registered queries.
"""
