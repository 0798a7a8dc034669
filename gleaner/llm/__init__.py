"""Operators of a training-data pipeline: deduplication, search, sharding, mixing, quality, chat, archives, packing."""
