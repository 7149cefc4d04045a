"""Operators for training-data pipelines over the documents table; nothing else in the library imports them."""
