"""Operators for training-data corpora: deduplication, decontamination, classifiers, archives, mixing, sharding."""
