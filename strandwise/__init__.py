"""Sequence property analytics as plain Spark DataFrame operators."""
