"""Training-data operators: deduplication, quality, licenses, mixing, fingerprints and token files."""
