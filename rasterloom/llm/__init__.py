"""Operators for preparing training text: mixing, packing, deduplication, filtering, fingerprints."""
