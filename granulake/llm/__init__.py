"""Operators for preparing training text, their queries and SQL twins.

Every operator takes the columns it needs by name, so further columns of the input, whatever they are
called, never clash with its own. Nothing else in the library imports this package.
"""
