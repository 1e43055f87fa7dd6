"""Partitioned log store, federated log queries and log lifecycle on Spark."""
