"""Operators for training data: token ids, mixes, reading levels, clusters and neighbours of vectors."""
