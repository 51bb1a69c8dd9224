"""Operators of a training-data pipeline: search, packing, tokens, duplicates, quality, personal data, language models."""
