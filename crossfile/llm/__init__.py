"""Operators a training-data pipeline needs, one module each.

Nothing else in the library imports this subpackage; ``queries`` holds its registered queries and their SQL.
"""
