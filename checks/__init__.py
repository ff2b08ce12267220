"""Registered queries and their SQL equivalents over the given tables."""
