"""Operators for the preparation of training text, one module each; nothing else in the library imports them."""
