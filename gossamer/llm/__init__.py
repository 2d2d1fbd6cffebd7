"""Training-data operators: formatting, packing, deduplication, filtering, mixing and scoring."""
