"""Operators for preparing training text: formatting, filtering, deduplication, mixing, sharding, encoding, scoring."""
