"""Training-data operators: scoring, language, near-duplicates, sharding, tokens, privacy, packing.

Nothing else in the library imports this subpackage.
"""
