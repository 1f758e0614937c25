"""Operators and pipeline for large-scale training data."""
