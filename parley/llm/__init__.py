"""Operators for training-data pipelines; self-contained, nothing outside imports it."""
