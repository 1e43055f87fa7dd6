"""Queries as values, compiled to predicates."""
