"""Operators of a training-data pipeline: quality, packing, secrets, token counts, nearest neighbours,
personal data, decontamination, sharding, URL filters and near-duplicates. Nothing else in the library imports this."""
