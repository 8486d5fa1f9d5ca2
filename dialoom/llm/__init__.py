"""Training-data operators: deduplication, filtering, tokenising, packing and search."""
