"""Training-data operators: deduplication, scoring, packing, mixing and sharding."""
