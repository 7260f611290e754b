"""Operators for preparing language-model training text, and the queries that apply them."""
