"""Training-data operators: quality, duplicates, privacy, search, packing, archives, token files."""
