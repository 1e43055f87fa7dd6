"""Operators for preparing training corpora.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library.  Every operator is a function from DataFrames to
DataFrames; ``queries`` holds the thin registered queries.
"""
