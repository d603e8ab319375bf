"""Operators for training data: top items per group, percentile summaries, token ids, mixtures and abusive content."""
