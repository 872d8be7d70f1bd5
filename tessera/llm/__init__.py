"""Training-data operators: archives, deduplication, packing, tokenizing, scoring, search, formatting."""
