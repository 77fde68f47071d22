"""Operators for preparing language-model training text; see ``queries.py``."""
