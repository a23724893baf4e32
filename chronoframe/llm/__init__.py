"""Training-data operators: tokenizing, filtering, deduplication, search and packing.

Nothing else in the library imports this subpackage; deleting it leaves the rest whole.
"""
