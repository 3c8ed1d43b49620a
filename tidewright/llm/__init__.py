"""Operators of a training-data pipeline: filtering, deduplication, decontamination, encoding, search and archives."""
