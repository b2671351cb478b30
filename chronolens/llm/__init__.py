"""Operators on text and vectors for training data; nothing outside imports this."""
