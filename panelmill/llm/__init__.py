"""Training-data operators: scoring, deduplication, search, packing and formatting of text tables."""
