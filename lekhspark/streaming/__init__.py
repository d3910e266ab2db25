"""Structured Streaming plans over the append-only logs."""
