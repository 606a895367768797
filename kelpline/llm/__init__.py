"""Training-data operators: quality, language, extraction, dedup, decontamination, mixing, sharding."""
