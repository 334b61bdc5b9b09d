"""Operators that prepare timed text as training data."""
