"""Training-data operators: deduplication, sharding, token files, search, extraction, scoring."""
