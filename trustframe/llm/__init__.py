"""Operators of a training-data pipeline over documents, conversations and vectors. Nothing else imports this package."""
