"""Queries over the given tables and their equivalents in plain SQL."""
