"""Stores, federations of stores, and framed or line-wise input."""
