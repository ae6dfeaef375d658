"""Operators that prepare training text: ten methods over `documents` and `pages`."""
