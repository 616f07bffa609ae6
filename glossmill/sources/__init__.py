"""Readers of documents, dictionaries and lists."""
