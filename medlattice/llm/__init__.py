"""Operators that prepare and check language-model training data."""
