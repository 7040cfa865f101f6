"""Training-data operators: extraction, deduplication, filtering, packing, sharding and search.

Nothing outside this subpackage imports it; the engine works without it.
"""
