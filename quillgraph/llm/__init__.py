"""Training-data operators (language id, deduplication, cleaning, packing, archives, scans)."""
