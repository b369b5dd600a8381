"""Operators of a training-data pipeline: search, scoring, near-duplicates,
secrets, licences, quality, mixing, packing and chat formatting."""
