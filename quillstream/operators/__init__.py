"""Relational operators of retrieval and question answering."""
