"""Scalar functions: time, keys, patterns, codecs and text."""
