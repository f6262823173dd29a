"""Training-data operators: deduplication, scoring, extraction, search, packing, mixing and sharding."""
