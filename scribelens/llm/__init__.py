"""Training-data operators: deduplication, filtering, scoring and mixing of document tables.

Nothing else in the package imports this subpackage.
"""
