"""Operators for preparing training text, and the queries over them."""
