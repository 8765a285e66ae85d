"""Operators of a training-data pipeline: sharding, extraction, filtering, dedup, tokenising and output."""
