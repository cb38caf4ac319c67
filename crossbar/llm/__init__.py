"""Training-data operators: packing, token files, search, filters and deduplication.

Nothing else in the library imports this subpackage, so it can be removed whole.
"""
