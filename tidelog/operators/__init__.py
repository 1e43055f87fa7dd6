"""Merge, coverage, statistics, balancing and access control."""
