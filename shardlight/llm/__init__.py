"""Training-data operators: formatting, deduplication, packing, extraction, mixing, scoring, media, storage, search.

Nothing outside this subpackage imports it.
"""
