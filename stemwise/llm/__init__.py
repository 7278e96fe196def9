"""Training-data operators: dedup, mixing, formatting, scoring, sharding, packing."""
