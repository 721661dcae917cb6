"""Training-data operators: deduplication, filtering, formatting, packing, tokenising, sharding."""
