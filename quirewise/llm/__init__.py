"""Training-data operators: mixing, cleaning, counting and sharding of large text corpora."""
