"""Operators of a training-data pipeline: quality, packing, mixing, sharding, archives, licenses, near copies, privacy."""
