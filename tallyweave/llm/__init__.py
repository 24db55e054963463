"""Corpus operators for training data: mixing, ordering, dedup, tokens, quality,
toxicity, language, nearest neighbours and web archives."""
