"""Operators that prepare training data for language models. Nothing outside imports this package."""
