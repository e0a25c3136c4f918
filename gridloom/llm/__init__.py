"""Training-data operators: filters, deduplication, token counts, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
