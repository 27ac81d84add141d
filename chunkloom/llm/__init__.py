"""Operators on text documents for training data; nothing else imports this package."""
