"""Training-data operators: dedup, mixing, filtering, packing and sharding of text corpora."""
