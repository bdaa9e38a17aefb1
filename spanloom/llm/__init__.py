"""Training-data operators: decontamination, mixing, archives, deduplication, filtering, sharding."""
