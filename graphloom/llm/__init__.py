"""Operators for large training-text pipelines."""
