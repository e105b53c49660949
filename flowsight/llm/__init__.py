"""Operators for preparing training text, their queries and SQL twins. Nothing else in the library imports this."""
