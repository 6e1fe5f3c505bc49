"""Operators for training data: groups, overlaps, splits, packing, leaks and sentences."""
