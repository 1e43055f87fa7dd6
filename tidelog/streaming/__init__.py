"""Structured Streaming: ingestion, late entries and heartbeats."""
