"""Identifier-list analytics as set-based PySpark operators."""
