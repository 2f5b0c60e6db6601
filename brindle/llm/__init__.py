"""Operators on training text and on very large numeric columns. Nothing outside this package imports it."""
