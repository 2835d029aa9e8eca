"""Training-data operators: deduplication, similarity joins, sharding, token files, scoring, search.

Nothing outside this folder imports it; the driver entry adds its queries when it is present.
"""
