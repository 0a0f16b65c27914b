"""Operators of a training-data pipeline: tokens, deduplication, search, language models, classifiers, packing."""
