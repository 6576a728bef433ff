"""Operators of a training-data pipeline over the tables of documents, pages, embeddings and labels.

Nothing outside this package imports it.
"""
