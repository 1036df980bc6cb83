"""Operators on texts for training data; nothing outside imports this."""
