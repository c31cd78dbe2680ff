"""Training-data operators: deduplication, search, scoring, packing, mixing and token output."""
