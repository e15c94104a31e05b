"""Training-data operators: scoring, tokenising, deduplicating, sharding and mixing corpora.

Nothing else in the package imports this subpackage.
"""
